"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2 r bits have a common variant within r bits of each. Each fingerprint goes once to every part of
the variant space (its first bits) that its ball touches; there its variants in that part are made, sorted and compared.
Any two fingerprints that share a variant are within 2 r bits, so each run of equal variants needs only links to its least
member: nothing grows with the square of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm import line_dedup
from courtside.llm.common import by_batch, components, lean, narrow, shared

BITS = 64


def shingle_hashes(body: bytes | None, width: int) -> np.ndarray:
    words = (body or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    n = len(words) - width + 1
    return np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bit b is 1 if it is set in more than half of the hashes; zero without any."""
    if not len(h):
        return 0
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): SimHash of the lower-cased `width`-word shingles of the whole text, as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([majority(shingle_hashes(t, width)) for t in b.column("body").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return by_batch(narrow(docs), run, "doc_id long, fp long")


def masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)], np.uint64)


def ball_links(fps: DataFrame, radius: int = 4, per_part: int = 1000) -> DataFrame:
    """(a, b) links of distinct `fp` values; their components are those of all pairs within `radius` bits (even radius).

    `per_part`: the number of parts doubles with the fingerprints, so that a part holds the variants of about that many.
    """
    half = -(-radius // 2)
    n = fps.count()
    p = max(2, min(24, int(np.ceil(np.log2(max(1, n / per_part))))))
    head, low = masks(p, half), 64 - p
    by_rest = [masks(low, half - r) for r in range(half + 1)]

    def to_parts(b: pa.RecordBatch) -> pa.Table:
        fp = b.column("fp").to_numpy().view(np.uint64)
        part = (fp >> np.uint64(low))[:, None] ^ head[None, :]
        return pa.table({"part": part.ravel().astype(np.int64), "fp": np.repeat(fp, len(head)).view(np.int64)})

    def collide(batches):
        held, held_part = [], None

        def flush():
            fp = np.unique(np.concatenate(held).view(np.uint64))
            away = np.bitwise_count((fp >> np.uint64(low)) ^ np.uint64(held_part))
            rest = fp & np.uint64((1 << low) - 1)
            variants, owner = [], []
            for r in range(half + 1):
                own = np.flatnonzero(away == r)
                if own.size:
                    variants.append((rest[own][:, None] ^ by_rest[r][None, :]).ravel())
                    owner.append(np.repeat(own, len(by_rest[r])))
            v, o = np.concatenate(variants), np.concatenate(owner)
            order = np.argsort(v, kind="stable")
            v, o = v[order], o[order]
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            sizes = np.diff(np.r_[starts, len(v)])
            many = sizes > 1
            if not many.any():
                return None
            inside = np.repeat(many, sizes)
            least = np.repeat(np.minimum.reduceat(o, starts)[many], sizes[many])
            pairs = np.unique(np.stack([least, o[inside]], 1), axis=0)
            a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
            near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
            return pa.RecordBatch.from_arrays([pa.array(a[near].view(np.int64)), pa.array(b[near].view(np.int64))], ["a", "b"])

        for batch in batches:
            part, fp = batch.column("part").to_numpy(), batch.column("fp").to_numpy()
            cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else [0]
            for s, e in zip(cuts, cuts[1:]):
                if held and part[s] != held_part and (out := flush()) is not None:
                    yield out
                if part[s] != held_part:
                    held, held_part = [], part[s]
                held.append(fp[s:e])
        if held and (out := flush()) is not None:
            yield out

    dealt = by_batch(fps.select("fp"), to_parts, "part long, fp long").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(lean(collide), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least doc_id that links can reach.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows appear as often; a null id
    never names a component while its component has another id. An empty table gives no rows.
    """
    own = shared(fingerprints(docs, width), "fingerprints")
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(ball_links(firsts, radius))
    classes = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Of each group of near-duplicate documents the one with the least id, with all columns; rows without an id stay."""
    names = near_duplicates(docs, width, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(names, docs["doc_id"] == names["_gone"], "left_anti")


def without_copies(docs: DataFrame, t: float = 0.8, width: int = 5, radius: int = 4, chunk_bytes: int = 4 << 20) -> DataFrame:
    """`docs` without each document that has an earlier near copy, kept or not: a smaller id and likeness `t` or more.

    Likeness: Jaccard of the lower-cased `width`-word shingles of the whole text, its whole word sequence if it has fewer
    words. All pairs are found, by the join of line_dedup over texts as one line each. Groups within `radius` bits keep their
    least id as in keep_first, texts without words among them. `docs` has to be a stored table, as for dedup_lines; it may have columns of any names. Chunks are smaller than for lines: a text is one set of many shingles.
    """
    own = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)]           # so that no name clashes with those added
    flat = docs.select(*own, F.col("doc_id"), F.translate("text", "\n", " ").alias("line"))
    left = line_dedup.dedup_lines(flat, t, width, "line", chunk_bytes=chunk_bytes, whole=width).where(F.size("removed_lines") == 0)
    left = left.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
    names = near_duplicates(docs, width, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return left.join(names, left["doc_id"] == names["_gone"], "left_anti")
