"""Substring dedup by a count-min prefilter: 20-word windows that also start earlier.

Texts are dealt once into chunks. Each chunk makes a partial sketch of the windows' least grams; parts of all sketches are
merged by cell range, and each chunk hears which of its cells count two or more. A window's grams occur at least as often
as the window, so the sketch never counts too few and no repeated window is lost. The second pass sends only windows that
are estimated repeated, once per chunk, to exact grouping; the third marks the words. Cells and shards grow with the input;
a shard serves several chunks, as each chunk sends a row to each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import chunks, least_gram, mixed, of_chunk, power_of_two, rolling, to_shards, word_spans, xxh64

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_LAST = np.iinfo(np.int64).max
#: How many chunks' cells, or windows, a shard takes.
_CELLS_OF, _WINDOWS_OF = 8, 2


class Windows:
    """Hashes of all windows of a chunk's documents, in order of (doc_id, start), and the gram that stands for each."""

    def __init__(self, bodies: list[bytes], width: int, gram: int):
        text = b" ".join(bodies) + b" "
        start, end = word_spans(np.frombuffer(text, np.uint8))
        ends = np.cumsum([len(b) + 1 for b in bodies], dtype=np.int64)
        self.sizes = np.diff(np.searchsorted(start, ends), prepend=0)
        h = xxh64(text, start, end - start)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        grams = rolling(h, gram)
        least = least_gram(grams, width - gram + 1)
        room = np.repeat(self.first[1:], self.sizes)[: len(least)] - np.arange(len(least))
        self.start = np.flatnonzero(room >= width)                      # windows inside one document
        self.anchor = least[self.start]
        self.grams = grams
        self.key = rolling(h, width, 0xD6E8FEB86659FD93)
        self.check = rolling(h, width, 0xA0761D6478BD642F)

    def repeated(self, seen: list[np.ndarray], bits: int) -> np.ndarray:
        """Window starts whose gram counts two or more in every row of the sketch."""
        new = self.fresh()
        ok = np.ones(int(new.sum()), bool)
        for r, cells in enumerate(seen):
            ok &= np.isin(cell_of(self.grams[self.anchor[new]], r, bits), cells)
        return self.start[ok[np.cumsum(new) - 1]] if len(ok) else self.start

    def fresh(self) -> np.ndarray:
        """Which windows have another gram than the window before: places of least grams never go back."""
        return np.diff(self.anchor, prepend=-1) > 0


def cell_of(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(grams ^ _SEEDS[row]) >> np.uint64(64 - bits)


def small(a: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as all of them fit in."""
    for t in (np.uint16, np.uint32, np.uint64):
        if not len(a) or a.max() <= np.iinfo(t).max:
            return a.astype(t).tobytes()


def wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, {0: np.uint16, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(b) // n if n else 0]).astype(np.uint64)


def repeated_cells(cells: list[np.ndarray], twice: list[np.ndarray]) -> list[np.ndarray]:
    """Of each chunk's distinct cells those that count two or more: held by two chunks, or `twice` by one. All are sorted once."""
    value, inverse, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    many = count > 1
    many[inverse[np.concatenate(twice)]] = True
    keep = many[inverse]
    return [c[k] for c, k in zip(cells, np.split(keep, np.cumsum([len(c) for c in cells])[:-1]))]


def first_in_chunk(w: Windows, ids: list, starts: np.ndarray):
    """Of each distinct window the first in the chunk, ordered by key: starts; and the other starts, which all come later."""
    key, check = w.key[starts], w.check[starts] >> np.uint64(32)
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
    doc = np.searchsorted(w.first, starts[order], side="right") - 1
    names = np.array([_LAST if i is None else i for i in ids], np.int64)
    place = starts[order] - w.first[doc]
    run = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    later = np.zeros(len(k), bool)
    if len(k):                                                       # stable: within a run, ascending (doc_id, start)
        hd, hp = names[doc[head]][run], place[head][run]
        later = (names[doc] > hd) | (names[doc] == hd) & (place > hp)
    # Rows of one id may repeat a place; then neither comes later here, and each shares the fate of the run's head.
    return k[head], c[head], doc[head], place[head], starts[order], run, later


def remove_repeated(docs: DataFrame, width: int = 20, gram: int = 10, depth: int = 2, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, removed, kept) of every row: words are runs of anything but ASCII white space.

    removed: stretches (start, length) of words covered by a window that also starts at a smaller (doc_id, start), judged
    on the input; kept: the other words joined by a space. Null and empty texts have no words. Rows without an id come
    last. Rows that repeat an id and a text are neither earlier than the other.
    """
    dealt, n, total = chunks(docs, chunk_bytes)
    ranges, shards = power_of_two(-(-n // _CELLS_OF)), power_of_two(-(-n // _WINDOWS_OF))
    bits = max(ranges.bit_length() + 8, min(ranges.bit_length() + 30, (total * 2 // 3).bit_length()))
    low = bits - (ranges.bit_length() - 1)

    def sketch(t: pa.Table) -> pa.Table:
        w = Windows(of_chunk(t)[1], width, gram)
        grams, out = w.grams[w.anchor[w.fresh()]], []
        for r in range(depth):
            cells, count = np.unique(cell_of(grams, r, bits), return_counts=True)
            cuts = to_shards(cells << np.uint64(64 - bits), ranges)
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    part = cells[a:b] & np.uint64((1 << low) - 1)
                    out.append((r * ranges + s, int(b - a), small(np.diff(part, prepend=np.uint64(0))), np.packbits(count[a:b] > 1).tobytes()))
        return table(out, t, "shard n a b")

    def table(out: list, t: pa.Table, names: str) -> pa.Table:
        chunk = t.column("chunk")[0].as_py() if t.num_rows else 0
        rows = [(chunk, *x) for x in out]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["chunk", *names.split()])

    def merge(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        cells = [np.cumsum(wide(a, k), dtype=np.uint64) for a, k in zip(t.column("a").to_pylist(), n)]
        twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for b, k in zip(t.column("b").to_pylist(), n)]
        rows = []
        for chunk, shard, c in zip(t.column("chunk").to_pylist(), t.column("shard").to_pylist(), repeated_cells(cells, twice)):
            if len(c):
                rows.append((chunk, shard, len(c), small(np.diff(c, prepend=np.uint64(0))), b""))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "shard", "n", "a", "b"])

    def heard(replies: pa.Table) -> list[np.ndarray]:
        seen = [[np.zeros(0, np.uint64)] for _ in range(depth)]
        for shard, n, a in zip(*(replies.column(c).to_pylist() for c in ("shard", "n", "a"))):
            if shard >= 0:
                seen[shard // ranges].append(np.cumsum(wide(a, n), dtype=np.uint64) + (np.uint64(shard % ranges) << np.uint64(low)))
        return [np.concatenate(s) for s in seen]

    def candidates(t: pa.Table, replies: pa.Table) -> pa.Table:
        ids, bodies = of_chunk(t)
        w = Windows(bodies, width, gram)
        key, check, doc, place, *_ = first_in_chunk(w, ids, w.repeated(heard(replies), bits))
        names, out = np.array([_LAST if i is None else i for i in ids], np.int64), []
        cuts = to_shards(key, shards)
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                own, local = np.unique(doc[a:b], return_inverse=True)
                parts = [key[a:b].tobytes(), check[a:b].astype(np.uint32).tobytes(), small(local.astype(np.uint64)), small(place[a:b].astype(np.uint64))]
                out.append((s, int(b - a), b"".join(parts), np.array([len(own), *map(len, parts)], np.int64).tobytes() + names[own].tobytes()))
        return table(out, t, "shard n a b")

    def group(t: pa.Table) -> pa.Table:
        keys, checks, docs_, places, sizes = [], [], [], [], t.column("n").to_pylist()
        for n, a, b in zip(sizes, t.column("a").to_pylist(), t.column("b").to_pylist()):
            head = np.frombuffer(b, np.int64)
            names, cut = head[5 : 5 + head[0]], np.r_[0, np.cumsum(head[1:5])]
            part = [a[x:y] for x, y in zip(cut, cut[1:])]
            keys.append(np.frombuffer(part[0], np.uint64)), checks.append(np.frombuffer(part[1], np.uint32))
            docs_.append(names[wide(part[2], n).astype(np.int64)]), places.append(wide(part[3], n))
        key, check, doc, place = map(np.concatenate, (keys, checks, docs_, places))
        order = np.lexsort((place, doc, check, key))
        k, c, d, p = key[order], check[order], doc[order], place[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.zeros(len(k), bool)
        later[order] = (d != d[head]) | (p != p[head])
        rows, at = [], 0
        for chunk, shard, n in zip(t.column("chunk").to_pylist(), t.column("shard").to_pylist(), sizes):
            if later[at : at + n].any():
                rows.append((chunk, -1 - shard, n, b"", np.packbits(later[at : at + n]).tobytes()))
            at += n
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "shard", "n", "a", "b"])

    def mark(t: pa.Table, replies: pa.Table) -> pa.Table:
        ids, bodies = of_chunk(t)
        w = Windows(bodies, width, gram)
        key, _, _, _, starts, run, later = first_in_chunk(w, ids, w.repeated(heard(replies), bits))
        cuts, gone = to_shards(key, shards), np.zeros(len(key), bool)
        for shard, n, b in zip(*(replies.column(c).to_pylist() for c in ("shard", "n", "b"))):
            if shard < 0:
                a = cuts[-1 - shard]
                gone[a : a + n] = np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
        starts = starts[later | gone[run]] if len(run) else starts
        edge = np.bincount(starts, minlength=int(w.first[-1]) + 1) - np.bincount(starts + width, minlength=int(w.first[-1]) + 1)
        cover = np.cumsum(edge[:-1]) > 0
        covered = np.r_[0, np.cumsum(cover)]
        spans, kept = [], []
        for body, at, n, some in zip(bodies, w.first, w.sizes, covered[w.first[1:]] > covered[w.first[:-1]]):
            words, own = body.split(), cover[at : at + n]
            if not some:
                spans.append([]), kept.append(b" ".join(words))
                continue
            change = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2)
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in change])
            kept.append(b" ".join([x for x, g in zip(words, own.tolist()) if not g]))
        return pa.table([pa.array(ids, pa.int64()), pa.array(w.sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_words", "removed", "kept"])

    rows = "chunk int, shard long, n long, a binary, b binary"
    own = dealt.groupBy("chunk")
    first = own.applyInArrow(sketch, rows).groupBy("shard").applyInArrow(merge, rows)
    second = own.cogroup(first.groupBy("chunk")).applyInArrow(candidates, rows).groupBy("shard").applyInArrow(group, rows)
    out = own.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(mark, "doc_id long, n_words long, removed array<struct<start: int, length: int>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
