"""Document fingerprints: SimHash of weighted word shingles, and permuted block tables to find those within a radius."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import WordHashes, mixed, narrow, pieces, rolling, shared

BITS = 128


def votes(text: str, memo: WordHashes, width: int = 3) -> bytes:
    """128 bits: each shingle of `width` lower-cased words votes with weight 1 + log2 of its count; all words if fewer."""
    words = text.lower().encode(errors="replace").split()
    if not words:
        return bytes(BITS // 8)
    h = memo.of(words)
    grams, count = np.unique(rolling(h, min(width, len(h))), return_counts=True)
    weight, total = 1 + np.log2(count), np.zeros(BITS)
    for at in range(0, len(grams), 4096):
        g, w = grams[at : at + 4096], weight[at : at + 4096]
        both = np.stack([g, mixed(g ^ np.uint64(0x5851F42D4C957F2D))], 1).astype(">u8").view(np.uint8).reshape(len(g), -1)
        total += w @ np.unpackbits(both, axis=1).astype(np.float32)
    return np.packbits(2 * total > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine of the angle that the differing bits estimate, 0 if they are half or more."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return 1.0 if not differ else max(0.0, float(np.cos(np.pi * differ / BITS)))


def edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is that with the next id (rows that repeat an id: by text), after the last the first; rows without
    an id come first. Rows are sorted by id over range partitions; only the last and first row of each meet once more.
    """
    rows = narrow(docs)
    n = pieces(rows, "octet_length(body)", part_bytes)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part long, first binary, last binary"

    def answer(doc, text, fp, after, after_fp, memo, part=None):
        e = edited(text, after)
        efp = votes(e, memo)
        return (doc, len(text), hashlib.sha256(e.encode()).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, after_fp), part, None, None)

    def batch(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    def run(batches):
        part, memo, held, first = TaskContext.get().partitionId(), WordHashes(), None, None
        for b in batches:
            out = []
            for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                text = (body or b"").decode(errors="replace")
                fp = votes(text, memo)
                if held is None:
                    first = text
                else:
                    out.append(answer(*held, text, fp, memo))
                held = (doc, text, fp)
            if out:
                yield batch(out)
        if held is not None:
            yield batch([(held[0], None, None, None, None, None, None, part, first.encode(), held[1].encode())])

    done = shared(rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("body").asc_nulls_first()).mapInArrow(run, schema), "fingerprints")
    ends = done.where("part IS NOT NULL").select("part", "doc_id", "first", "last")
    # One narrow row per partition finds the partition that follows; the texts join on it.
    follow = ends.select("part").withColumn("after", F.lead("part").over(Window.orderBy("part")))
    follow = follow.withColumn("after", F.coalesce("after", F.first("part").over(Window.orderBy("part"))))
    meet = ends.join(follow, "part").join(ends.select(F.col("part").alias("after"), F.col("first").alias("after_text")), "after").select("doc_id", "last", "after_text")

    def close(batches):
        memo = WordHashes()
        for b in batches:
            out = []
            for doc, last, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "last", "after_text"))):
                last, after = last.decode(), after.decode()
                out.append(answer(doc, last, votes(last, memo), after, votes(after, memo), memo))
            if out:
                yield batch(out)

    out = done.where("part IS NULL").unionByName(meet.mapInArrow(close, schema))
    text = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return out.select("doc_id", "n_chars", "edited_sha256", *text, "near_edited", "near_next")


def near(fps: DataFrame, queries: DataFrame, radius: int = 3, spare: int = 0) -> DataFrame:
    """(query, match, distance): distinct fingerprints (32 hex digits) of `fps` within `radius` bits of those of `queries`.

    The bits are cut into radius + spare + 1 blocks; two fingerprints that differ in `radius` bits agree on at least
    spare + 1 blocks. There is one table for each choice of spare + 1 blocks, keyed by them, so no match is lost.
    """
    count = radius + spare + 1
    cuts = [BITS * k // count for k in range(count + 1)]
    bits = lambda c: F.concat(*[F.lpad(F.conv(F.substring(c, i, 8), 16, 2), 32, "0") for i in (1, 9, 17, 25)])
    tables = list(combinations(range(count), spare + 1))

    def keyed(df, name):
        one = df.select(F.col("fingerprint").alias(name)).where("fingerprint IS NOT NULL").distinct().withColumn("bits", bits(name))
        key = [F.struct(F.lit(t).alias("table"), F.concat(*[F.substring("bits", cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in blocks]).alias("key")) for t, blocks in enumerate(tables)]
        return one.select(name, F.explode(F.array(*key)).alias("at")).select(name, F.col("at.table").alias("table"), F.xxhash64("at.key").alias("key"))

    words = lambda c: [F.conv(F.substring(c, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)]
    pairs = keyed(queries, "query").join(keyed(fps, "match"), ["table", "key"])
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(words("query"), words("match"))), F.lit(0))
    return pairs.select("query", "match", distance.alias("distance")).where(F.col("distance") <= radius).distinct()
