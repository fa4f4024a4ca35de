"""Line dedup: an exact set-similarity join of lines.

A line's tokens are its lower-cased words, or shingles of some words, each once. Tokens are ordered by rarity, so that two
sets of Jaccard likeness t or more share a token among their first |x| - ceil(t |x|) + 1. Texts are hashed once into batches
of line sets (hash, size, parity bitmap, prefix). Batches then send first the set hashes, each distinct value once (equal
sets keep their first line), then the prefix tokens of the lines left with sizes, places and bitmaps: under each token the
length, positional and bitmap filters tell which lines can be like another, and the batches hear which. Only those meet with
all their tokens, under tokens that these lines share. There a second shared prefix token decides which earlier lines to
verify; one match is enough, so a group of variants is not paired in full. No filter loses a pair.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import lean, mixed, narrow, pieces, power_of_two, rolling, shared, shuffles_removed, slices, sliding_min, to_shards, word_spans, xxh64

CELLS_BITS = 18                      # the rarity sketch has this many cells, one byte each once merged
_BLOCK = 16
_PACK_BYTES = 16 << 20               # texts a task holds before it packs them
_RUN_BYTES = 2 << 20                 # texts whose words are hashed at once, or one longer text
_BITMAP, _WIDE_BITMAP = 128, 512     # bits of a set's parity bitmap, and of a second one if it has more than _WIDE tokens
_WIDE = 128
_LONG_RUN = 20_000                   # lines under one token that are no longer compared by bitmaps; all of them are verified
_SHORT_RUN = 32                      # in longer lists a second token decides which lines are verified
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIX = np.uint64(0xFFFFFFFFFFFF0000)


def six(v: np.ndarray) -> bytes:
    """The upper six bytes of 64-bit numbers."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def packed_by_chunk(batches):
    """The rows of each chunk as compressed Arrow streams (chunk, rows): texts cross the network once, at a third of their size."""
    held, size = [], 0

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        chunk = t.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        at = chunk[order]
        cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for x, y in zip(cuts, cuts[1:]):
            rows = t.take(pa.array(order[x:y])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([at[x]], pa.int32()), pa.array([squeeze(sink.getvalue())], pa.binary())], ["chunk", "rows"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= _PACK_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def unpacked(t: pa.Table) -> pa.Table:
    expand = zstandard.ZstdDecompressor().decompress
    return pa.concat_tables(pa.ipc.open_stream(expand(rows.as_py())).read_all() for rows in t.column("rows"))


def lower(body: bytes) -> bytes:
    return body.decode(errors="replace").lower().encode()


def hashed_words(lines: list[bytes], width: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, hashes) of the words of some lines, or of texts of several lines; a count for each line.

    The words of a line of fewer than `whole` are joined to one that no other line has, with empty ones to fill one shingle.
    """
    text = b"\n".join(lines) + b"\n"
    at = np.frombuffer(text, np.uint8)
    start, end = word_spans(at)
    newline = np.flatnonzero(at == 10)
    counts = np.diff(np.searchsorted(start, newline), prepend=0)
    h = xxh64(text, start, end - start)
    few = np.flatnonzero((counts > 0) & (counts < whole))
    if len(few):
        first = np.cumsum(counts) - counts
        joined = [xxhash.xxh64_intdigest(b" ".join(text[x:y].split()) + b" ", 0) for x, y in zip(start[first[few]].tolist(), newline[few].tolist())]
        single = np.zeros(len(counts), bool)
        single[few] = True
        kept = ~np.repeat(single, counts)
        counts[few] = width
        longer = ~np.repeat(single, counts)
        words, h = h[kept], np.full(len(longer), xxhash.xxh64_intdigest(b"", 0), np.uint64)
        h[longer], h[(np.cumsum(counts) - counts)[few]] = words, joined
    return counts, h


def tokens_of(h: np.ndarray, counts: np.ndarray, width: int, ranks: np.ndarray):
    """(hashes, line, rank) of the shingles of some lines of `counts` hashed words each; lines with fewer than `width` have none.

    A shingle ranks as the rarest of its words.
    """
    grams, rank = rolling(h, width), sliding_min(ranks[(h >> np.uint64(64 - CELLS_BITS)).astype(np.int64)], width)
    line = np.repeat(np.arange(len(counts)), counts)[: len(grams)]
    inside = np.cumsum(counts)[line] - np.arange(len(grams)) >= width
    return grams[inside], line[inside], rank[inside]


def rarity(docs: DataFrame) -> np.ndarray:
    """For each cell of hashed words, four times the binary logarithm of their count, as one byte.

    Any order of tokens that is the same for all lines keeps the join exact; counts only make it fast. All texts are counted.
    Each task counts its own words (letters beyond ASCII as they stand); what leaves it is its cells, merged in two steps. The driver gets 2^18
    bytes whatever the input.
    """
    shift = np.uint64(64 - CELLS_BITS)

    def count(batches):
        cells = np.zeros(1 << CELLS_BITS, np.int64)
        for b in batches:
            for part in slices([b], _RUN_BYTES):
                text = b"\n".join(x or b"" for x in part.column("body").to_pylist()).lower() + b"\n"
                start, end = word_spans(np.frombuffer(text, np.uint8))
                cells += np.bincount((xxh64(text, start, end - start) >> shift).astype(np.int64), minlength=1 << CELLS_BITS)
        at = np.flatnonzero(cells)
        cuts = np.searchsorted(at, np.arange(0, (1 << CELLS_BITS) + 1, 1 << _BLOCK))
        salt = TaskContext.get().partitionId() % 8
        rows = [(k, salt, (at[s:e] - (k << _BLOCK)).astype(np.uint16).tobytes(), cells[at[s:e]].astype(np.uint32).tobytes()) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["block", "salt", "at", "n"])

    def merge(kind, keep_salt):
        def run(t: pa.Table) -> pa.Table:
            cells = np.zeros(1 << _BLOCK, np.int64)
            for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist()):
                cells[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)
            at = np.flatnonzero(cells)
            row = [t.column("block")[0].as_py(), t.column("salt")[0].as_py() if keep_salt else 0, at.astype(np.uint16).tobytes(), cells[at].tobytes()]
            return pa.table({n: [v] for n, v in zip(("block", "salt", "at", "n"), row)}, schema=pa.schema([("block", pa.int64()), ("salt", pa.int64()), ("at", pa.binary()), ("n", pa.binary())]))

        return run

    schema = "block long, salt long, at binary, n binary"
    parts = narrow(docs).mapInArrow(lean(count), schema)
    parts = parts.groupBy("block", "salt").applyInArrow(merge(np.uint32, True), schema).groupBy("block").applyInArrow(merge(np.int64, False), schema)
    out = np.zeros(1 << CELLS_BITS, np.uint8)
    for r in parts.collect():
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64) + (r["block"] << _BLOCK)
        out[at] = np.minimum(255, np.log2(np.frombuffer(r["n"], np.int64) + 1) * 4).astype(np.uint8)
    return out


def needed(a: int, b: int, t: float) -> int:
    """Shared words that two sets of these sizes must have."""
    return math.ceil(t / (1 + t) * (a + b) - 1e-9)


def ordered_sets(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, line) of distinct tokens per line (fewer than 4096 lines), rare ones first; the hash settles ties."""
    key = (line.astype(np.uint64) << np.uint64(52)) | (rank.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key = np.sort(key)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key & np.uint64((1 << 52) - 1), (key >> np.uint64(52)).astype(np.int64)


def bitmaps(h: np.ndarray, line: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A row of 64-bit words for each of `n` lines: whether an odd number of its tokens falls into each of `bits` cells.

    Two rows differ in no more bits than their sets differ in tokens.
    """
    cell = (mixed(h) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(line * bits + cell, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64).reshape(n, bits // 64)


def likely(value: np.ndarray, size: np.ndarray, place: np.ndarray, bits: np.ndarray, wide: np.ndarray, t: float) -> np.ndarray:
    """Flags the postings under each token that some other posting under it can be like, by sizes, places and bitmaps.

    `value` ascending and `size` ascending within it; `wide` has the rows of the sets of more than _WIDE tokens, in their order.
    """
    n = len(value)
    new = np.r_[True, value[1:] != value[:-1]]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], n]
    run = np.cumsum(new) - 1
    flag, end = (ends - starts > _LONG_RUN)[run], ends[run]
    at_wide = np.cumsum(size > _WIDE) - 1
    i, d = np.flatnonzero(~flag), 0
    while len(i):
        d += 1
        i = i[i + d < end[i]]
        i = i[size[i] >= t * size[i + d] - 1e-9]
        j = i + d
        both = size[i] + size[j]
        need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
        near = np.minimum(size[i] - place[i], size[j] - place[j]) + np.minimum(place[i], place[j]) >= need
        near &= np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= both - 2 * need
        x, y, most = i[near], j[near], (both - 2 * need)[near]
        w = np.flatnonzero(size[x] > _WIDE)
        if len(w):
            far = np.bitwise_count(wide[at_wide[x[w]]] ^ wide[at_wide[y[w]]]).sum(1, dtype=np.int64) > most[w]
            x, y = np.delete(x, w[far]), np.delete(y, w[far])
        flag[x] = flag[y] = True
    return flag


def prefix_of(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of these lengths."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


_ROWS = "batch long, shard long, n long, a binary"
_AS_CHUNK = ["CAST(batch AS int) AS chunk", "shard", "n", "a"]          # of the type that dealt texts have


def _rows(rows: list) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["batch", "shard", "n", "a"])


def _flags(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


class Sets:
    """One batch of line sets, read back."""

    names = ("doc", "line", "chunk", "crc", "sig", "size", "bits", "wide", "prefix")
    kinds = (np.int64, np.int32, np.int32, np.uint32, np.uint64, np.int32, np.uint64, np.uint64, np.uint64)

    def __init__(self, t: pa.Table, t_like: float):
        for name, kind in zip(self.names[:-1], self.kinds):
            setattr(self, name, np.frombuffer(t.column(name)[0].as_py(), kind))
        self.prefix = from_six(t.column("prefix")[0].as_py())
        self.size = self.size.astype(np.int64)
        self.bits, self.wide = self.bits.reshape(-1, 2), self.wide.reshape(-1, _WIDE_BITMAP // 64)
        self.at_wide = np.cumsum(self.size > _WIDE) - 1
        self.per = prefix_of(self.size, t_like)
        self.of = np.repeat(np.arange(len(self.size)), self.per)              # the line of each prefix word
        order = np.lexsort((self.line, self.doc, self.sig))
        s = self.sig[order]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        self.head = order[np.flatnonzero(new)]                                 # the first line of each distinct set
        self.run = np.empty(len(order), np.int64)
        self.run[order] = np.cumsum(new) - 1

    def later_than(self, i: np.ndarray) -> np.ndarray:
        """Lines that come after line i[k] of their set."""
        d, n = self.doc[i][self.run], self.line[i][self.run]
        return (self.doc > d) | (self.doc == d) & (self.line > n)


def later_lines(docs: DataFrame, dealt: DataFrame, t: float, width: int, n: int, whole: int = 0, batch_bytes: int = 8 << 20) -> DataFrame:
    """(chunk, doc_id, line, crc) of each line to remove, for texts packed into `n` chunks; see dedup_lines."""
    ranks = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    shards = power_of_two(n)
    schema = "batch long, " + ", ".join(f"{x} binary" for x in Sets.names)

    def digest(batches):
        table, part, number = ranks.value, TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ids, chunk, bodies = (b.column(c).to_pylist() for c in ("doc_id", "chunk", "body"))
            at = 0
            while at < len(ids):
                out, size = [[] for _ in Sets.names], 0

                def close(doc, line, own, crc, counts, words):
                    h, k = ordered_sets(*tokens_of(words, counts, width, table))
                    sizes = np.bincount(k, minlength=len(counts))
                    first = np.cumsum(sizes) - sizes
                    m = mixed(h * _MIX)
                    sig = np.add.reduceat(m, first) ^ (np.bitwise_xor.reduceat(m, first) * _MIX)
                    per = prefix_of(sizes, t)
                    prefix = h[np.repeat(first, per) + _within(per)]
                    bits, many = bitmaps(h, k, len(counts), _BITMAP), sizes > _WIDE
                    inside = many[k]
                    wide = bitmaps(h[inside], (np.cumsum(many) - 1)[k[inside]], int(many.sum()), _WIDE_BITMAP)
                    for o, v in zip(out, (doc, line, own, crc, sig, sizes, bits.ravel(), wide.ravel(), prefix)):
                        o.append(v)

                while at < len(ids) and size < batch_bytes:
                    run, held = [], 0
                    while at < len(ids) and size < batch_bytes and held < _RUN_BYTES:
                        if bodies[at] and ids[at] is not None:
                            run.append(at)
                            held += len(bodies[at])
                            size += len(bodies[at])
                        at += 1
                    if not run:
                        continue
                    counts, words = hashed_words([lower(bodies[i]) for i in run], width, whole)
                    raw = [bodies[i].split(b"\n") for i in run]
                    crc = np.fromiter((zlib.crc32(x) for r in raw for x in r), np.uint32, len(counts))
                    per_doc = np.array([len(r) for r in raw])
                    doc, own = (np.repeat(np.array([v[i] for i in run]), per_doc) for v in (ids, chunk))
                    lines, words = np.flatnonzero(counts >= width), words[np.repeat(counts >= width, counts)]
                    columns = [c[lines] for c in (doc, _within(per_doc), own, crc, counts)]
                    ends = np.r_[0, np.cumsum(columns[-1])]
                    for x in range(0, len(lines), 4000):
                        close(*(c[x : x + 4000] for c in columns), words[ends[x] : ends[min(len(lines), x + 4000)]])
                if out[0]:
                    cols = [np.concatenate(o).astype(kind) for o, kind in zip(out, Sets.kinds)]
                    cols = [c.tobytes() for c in cols[:-1]] + [six(mixed(cols[-1]))]
                    yield pa.RecordBatch.from_arrays([pa.array([part + number])] + [pa.array([c], pa.binary()) for c in cols], ["batch", *Sets.names])
                    number += 1

    chunk = dealt_chunk(n)
    # one exchange by batch holds the sets for all three steps below; they are stored nowhere else
    own = narrow(docs).withColumn("chunk", chunk).mapInArrow(lean(digest), schema).repartition("batch").groupBy("batch")

    def send_sets(b: pa.Table) -> pa.Table:
        s = Sets(b, t)
        sig, cuts = s.sig[s.head], to_shards(s.sig[s.head], shards)
        return _rows([(b.column("batch")[0].as_py(), j, int(y - x), sig[x:y].tobytes() + s.doc[s.head[x:y]].tobytes() + s.line[s.head[x:y]].tobytes()) for j, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x])

    def first_of_all(tab: pa.Table) -> pa.Table:
        sizes, parts = tab.column("n").to_pylist(), tab.column("a").to_pylist()
        sig, doc, line = (np.concatenate([np.frombuffer(a[w * m : v * m], kind) for a, m in zip(parts, sizes)]) for w, v, kind in ((0, 8, np.uint64), (8, 16, np.int64), (16, 20, np.int32)))
        order = np.lexsort((line, doc, sig))
        s, d, p = sig[order], doc[order], line[order]
        new = np.r_[True, s[1:] != s[:-1]]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rep, late = np.zeros(len(sig), bool), np.zeros(len(sig), bool)
        rep[order], late[order] = new, (d != d[head]) | (p != p[head])
        rows, at = [], 0
        for batch, shard, m in zip(tab.column("batch").to_pylist(), tab.column("shard").to_pylist(), sizes):
            rows.append((batch, shard, m, np.packbits(rep[at : at + m]).tobytes() + np.packbits(late[at : at + m]).tobytes()))
            at += m
        return _rows(rows)

    def heard(s: Sets, replies: pa.Table):
        """(first lines of their sets, sets whose first line is elsewhere, replies on words)."""
        cuts = to_shards(s.sig[s.head], shards)
        rep, late, words = np.zeros(len(s.head), bool), np.zeros(len(s.head), bool), {}
        for shard, m, a in zip(*(replies.column(c).to_pylist() for c in ("shard", "n", "a"))):
            if shard >= 0:
                half, x = len(a) // 2, cuts[shard]
                rep[x : x + m], late[x : x + m] = _flags(a[:half], m), _flags(a[half:], m)
            else:
                words[-1 - shard] = (m, a)
        return rep, late, words

    def prefix_words(s: Sets, rep: np.ndarray) -> np.ndarray:
        """Where the prefix tokens of the batch's first lines are, in order of tokens."""
        mine = np.zeros(len(s.size), bool)
        mine[s.head[rep]] = True
        at = np.flatnonzero(mine[s.of])
        return at[np.argsort(s.prefix[at], kind="stable")]

    def places(s: Sets) -> np.ndarray:
        return np.arange(len(s.of)) - (np.cumsum(s.per) - s.per)[s.of]

    def send_words(b: pa.Table, replies: pa.Table) -> pa.Table:
        """Each prefix token with a number for its line, the line's size, the token's place, and the line's bitmap."""
        s = Sets(b, t)
        at = prefix_words(s, heard(s, replies)[0])
        value, own, place = s.prefix[at], s.of[at], places(s)[at].astype(np.int32)
        name, size, batch, rows = mixed(s.sig[own]), s.size[own].astype(np.int32), b.column("batch")[0].as_py(), []
        cuts = to_shards(value, shards)
        for j, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:
                i = own[x:y]
                wide = s.wide[s.at_wide[i[s.size[i] > _WIDE]]]
                rows.append((batch, j, int(y - x), six(value[x:y]) + six(name[x:y]) + size[x:y].tobytes() + place[x:y].tobytes() + s.bits[i].tobytes() + wide.tobytes()))
        return _rows(rows)

    def shared_words(tab: pa.Table) -> pa.Table:
        """Which of a batch's postings can be like another under the same token, and a sum over the token's such lines."""
        sizes, parts = tab.column("n").to_pylist(), tab.column("a").to_pylist()
        read = lambda x, y, kind: np.concatenate([np.frombuffer(a[x * m : y * m], kind) for a, m in zip(parts, sizes)])
        value, name = (np.concatenate([from_six(a[x * m : (x + 6) * m]) for a, m in zip(parts, sizes)]) for x in (0, 6))
        size, place, bits = read(12, 16, np.int32).astype(np.int64), read(16, 20, np.int32).astype(np.int64), read(20, 36, np.uint64).reshape(-1, 2)
        wide = np.concatenate([np.frombuffer(a[36 * m :], np.uint64) for a, m in zip(parts, sizes)]).reshape(-1, _WIDE_BITMAP // 64)
        order = np.lexsort((size, value))
        long = order[size[order] > _WIDE]
        wide = wide[(np.cumsum(size > _WIDE) - 1)[long]]
        v = value[order]
        flag = likely(v, size[order], place[order], bits[order], wide, t)
        new = np.r_[True, v[1:] != v[:-1]]
        whole_ = np.add.reduceat(np.where(flag, name[order], np.uint64(0)), np.flatnonzero(new))[np.cumsum(new) - 1] & _SIX
        many, total = np.zeros(len(v), bool), np.zeros(len(v), np.uint64)
        many[order], total[order] = flag, whole_
        rows, at = [], 0
        for batch, shard, m in zip(tab.column("batch").to_pylist(), tab.column("shard").to_pylist(), sizes):
            own = many[at : at + m]
            if own.any():
                rows.append((batch, -1 - shard, m, np.packbits(own).tobytes() + six(total[at : at + m][own])))
            at += m
        return _rows(rows)

    def settle(b: pa.Table, replies: pa.Table) -> pa.Table:
        """By chunk: lines that equal an earlier one (shard 0), and first lines with shared words, each with these (shard 1)."""
        s = Sets(b, t)
        rep, late, words = heard(s, replies)
        gone = np.flatnonzero(late[s.run] | s.later_than(s.head))
        at = prefix_words(s, rep)
        cuts, many, total = to_shards(s.prefix[at], shards), np.zeros(len(at), bool), np.zeros(len(at), np.uint64)
        for shard, (m, a) in words.items():
            own = _flags(a[: (m + 7) // 8], m)
            many[cuts[shard] : cuts[shard] + m] = own
            total[cuts[shard] : cuts[shard] + m][own] = from_six(a[(m + 7) // 8 :])
        at, total = at[many], total[many]
        if len(at):
            # Tokens that the same lines have bring the same lines together: of these, a line goes under the least one only.
            order = np.lexsort((s.prefix[at], total, s.of[at]))
            o, w = s.of[at][order], total[order]
            at = np.sort(at[order[np.r_[True, (o[1:] != o[:-1]) | (w[1:] != w[:-1])]]])
        place = places(s)[at]
        lines, counts = np.unique(s.of[at], return_counts=True)
        rows = []
        for c in np.unique(s.chunk[gone]):
            i = gone[s.chunk[gone] == c]
            rows.append((int(c), 0, len(i), s.doc[i].tobytes() + s.line[i].tobytes() + s.crc[i].tobytes()))
        order = np.argsort(s.chunk[lines], kind="stable")
        start = np.cumsum(counts) - counts
        for part in np.split(order, np.flatnonzero(np.diff(s.chunk[lines[order]])) + 1) if len(order) else []:
            i = lines[part]
            words_at = np.repeat(start[part], counts[part]) + _within(counts[part])
            rows.append((int(s.chunk[i[0]]), 1, len(i), s.doc[i].tobytes() + s.line[i].tobytes() + s.crc[i].tobytes() + counts[part].astype(np.int32).tobytes() + place[words_at].astype(np.int32).tobytes()))
        return _rows(rows)

    first = own.applyInArrow(lean(send_sets), _ROWS).groupBy("shard").applyInArrow(lean(first_of_all), _ROWS)
    second = own.cogroup(first.groupBy("batch")).applyInArrow(lean(send_words), _ROWS).groupBy("shard").applyInArrow(lean(shared_words), _ROWS)
    with shuffles_removed(docs.sparkSession):                      # nothing below reads the sets or the postings again
        settled = shared(own.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(lean(settle), _ROWS).selectExpr(*_AS_CHUNK), "line-words")

    few = max(1, shards // 8)

    def send_lines(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """Under each shared word, by shard: its lines with size, place, and words, rare ones first."""
        if not asked.num_rows:
            return _rows([])
        text, table, rows = unpacked(texts), ranks.value, []
        bodies: dict[int, list] = {}
        for d, body in zip(text.column("doc_id").to_pylist(), text.column("body").to_pylist()):
            bodies.setdefault(d, []).append(body)
        chunk = texts.column("chunk")[0].as_py()
        # the lines that all batches ask of this chunk go out together: a row for each batch would be as many as batches times chunks
        sizes, parts = asked.column("n").to_pylist(), asked.column("a").to_pylist()
        doc, line, crc, counts = (np.concatenate([np.frombuffer(a[x * m : y * m], kind) for a, m in zip(parts, sizes)]) for x, y, kind in ((0, 8, np.int64), (8, 12, np.int32), (12, 16, np.uint32), (16, 20, np.int32)))
        place, m = np.concatenate([np.frombuffer(a[20 * m :], np.int32) for a, m in zip(parts, sizes)]), sum(sizes)
        ends = np.cumsum(counts)
        for x in range(0, m, 4000):
            found = []
            held: dict[int, list] = {}
            for d, k, c in zip(doc[x : x + 4000].tolist(), line[x : x + 4000].tolist(), crc[x : x + 4000].tolist()):
                if d not in held:
                    held[d] = [(b.split(b"\n"), lower(b).split(b"\n")) for b in bodies[d] if b]
                found.append(next(low[k] for raw, low in held[d] if k < len(raw) and zlib.crc32(raw[k]) == c))
            sizes, words = hashed_words(found, width, whole)
            h, of = ordered_sets(*tokens_of(words, sizes, width, table))
            size = np.bincount(of, minlength=len(sizes))
            begin = np.cumsum(size) - size
            own = counts[x : x + 4000].astype(np.int64)
            pos = place[ends[x] - counts[x] : ends[min(m, x + 4000) - 1]].astype(np.int64)
            who = np.repeat(np.arange(len(sizes)), own)
            word = h[begin[who] + pos]
            shard = (mixed(word) >> np.uint64(40)).astype(np.int64) % few
            for s in np.unique(shard):
                i = np.flatnonzero(shard == s)
                lines, local = np.unique(who[i], return_inverse=True)
                flat = h[np.repeat(begin[lines], size[lines]) + _within(size[lines])]
                rows.append((chunk, int(s), len(i), np.array([len(lines)], np.int64).tobytes() + (word[i] << np.uint64(12) & _SIX).tobytes() + local.astype(np.int32).tobytes() + pos[i].astype(np.int32).tobytes() + doc[x + lines].tobytes() + line[x + lines].tobytes() + crc[x + lines].tobytes() + size[lines].astype(np.int32).tobytes() + six(flat << np.uint64(12))))
        return _rows(rows)

    def verify(tab: pa.Table) -> pa.Table:
        word, who, pos, doc, line, crc, chunk, size, flat, held = [], [], [], [], [], [], [], [], [], 0
        for c, n_, a in zip(tab.column("batch").to_pylist(), tab.column("n").to_pylist(), tab.column("a").to_pylist()):
            m = int(np.frombuffer(a[:8], np.int64)[0])
            cut = np.cumsum([8, 8 * n_, 4 * n_, 4 * n_, 8 * m, 4 * m, 4 * m, 4 * m])
            part = [a[p:q] for p, q in zip(cut, cut[1:])]
            word.append(np.frombuffer(part[0], np.uint64)), who.append(np.frombuffer(part[1], np.int32) + held), pos.append(np.frombuffer(part[2], np.int32))
            doc.append(np.frombuffer(part[3], np.int64)), line.append(np.frombuffer(part[4], np.int32)), crc.append(np.frombuffer(part[5], np.uint32)), chunk.append(np.full(m, c))
            size.append(np.frombuffer(part[6], np.int32).astype(np.int64)), flat.append(from_six(a[cut[-1] :]))
            held += m
        word, who, pos, doc, line, crc, chunk, size, flat = map(np.concatenate, (word, who, pos, doc, line, crc, chunk, size, flat))
        first = np.cumsum(size) - size
        gone = np.zeros(len(size), bool)
        order = np.lexsort((line[who], doc[who], word))
        w = word[order]
        starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        length = np.diff(np.r_[starts, len(w)])
        match_short_runs(who[order], pos[order].astype(np.int64), length, flat, first, size, gone, t)
        for x, n in zip(starts[length > _SHORT_RUN].tolist(), length[length > _SHORT_RUN].tolist()):
            run = order[x : x + n]
            if not gone[who[run[1:]]].all():
                match_run(int(word[run[0]]), who[run].tolist(), pos[run].tolist(), lambda i: flat[first[i] : first[i] + size[i]], gone, t)
        rows = []
        for c in np.unique(chunk[gone]):
            i = np.flatnonzero(gone & (chunk == c))
            rows.append((int(c), 0, len(i), doc[i].tobytes() + line[i].tobytes() + crc[i].tobytes()))
        return _rows(rows)

    asked = settled.where("shard = 1").groupBy("chunk")
    near = dealt.groupBy("chunk").cogroup(asked).applyInArrow(lean(send_lines), _ROWS).groupBy("shard").applyInArrow(lean(verify), _ROWS)
    return settled.where("shard = 0").unionByName(near.selectExpr(*_AS_CHUNK))


def shared_tokens(x: np.ndarray, y: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many tokens set x[k] shares with set y[k], for at most 2^16 pairs of sets of 48-bit tokens (the upper bits of `flat`)."""
    pair, both = np.tile(np.arange(len(x), dtype=np.uint64), 2), np.r_[x, y]
    key = np.sort(flat[np.repeat(first[both], size[both]) + _within(size[both])] | np.repeat(pair, size[both]))
    return np.bincount((key[1:][key[1:] == key[:-1]] & ~_SIX).astype(np.int64), minlength=len(x))


def match_short_runs(who: np.ndarray, pos: np.ndarray, length: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray, gone: np.ndarray, t: float) -> None:
    """Marks each line that is like an earlier one, in lists of at most _SHORT_RUN lines that share a token.

    `who` has the lines of lists of these lengths, in order of (doc, line), `pos` the places of the token. Each line meets its
    neighbour, then the line before that, and so on until it is marked; two lines that share several tokens are verified once.
    """
    n = len(size)
    end, tried, d = np.repeat(np.cumsum(length), length), np.zeros(0, np.int64), 0
    i = np.flatnonzero(np.repeat(length <= _SHORT_RUN, length))
    while len(i):
        d += 1
        i = i[i + d < end[i]]
        own = i[~gone[who[i + d]]]
        x, y, p, q = who[own], who[own + d], pos[own], pos[own + d]
        a, b = size[x], size[y]
        near = (np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9) & (np.minimum(a - p, b - q) + np.minimum(p, q) >= np.ceil(t / (1 + t) * (a + b) - 1e-9))
        pairs = np.setdiff1d(y[near] * n + x[near], tried)
        tried = np.union1d(tried, pairs)
        x, y = pairs % n, pairs // n
        block = np.cumsum(np.maximum(size[x] + size[y], 16)) >> 20
        for lo, hi in zip(starts := np.searchsorted(block, np.unique(block)), [*starts[1:], len(block)]):
            live = lo + np.flatnonzero(~gone[y[lo:hi]])
            a, b = x[live], y[live]
            gone[b[shared_tokens(a, b, flat, first, size) >= np.ceil(t / (1 + t) * (size[a] + size[b]) - 1e-9)]] = True


def match_run(word: int, who: list[int], pos: list[int], tokens: Callable[[int], np.ndarray], gone: np.ndarray, t: float) -> None:
    """Marks each line with an earlier one of likeness t in a list of lines that share `word`, in order of (doc, line)."""
    index: dict[int, list[int]] = {}
    listed: dict[int, list[int]] = {}
    full: dict[int, frozenset] = {}

    def words(i: int) -> frozenset:
        if i not in full:
            full[i] = frozenset(tokens(i).tolist())
        return full[i]

    for k, (y, p) in enumerate(zip(who, pos)):
        n = len(tokens(y))
        ahead = tokens(y)[: n - math.ceil(t * n - 1e-9) + 2].tolist()       # likes share two words of these
        listed[k] = ahead
        if not gone[y]:
            tried, done = set(), False
            for second in ahead:
                for j in index.get(second, ()) if second != word else ():
                    if j in tried:
                        continue
                    tried.add(j)
                    x = who[j]
                    m = len(tokens(x))
                    if min(n, m) < t * max(n, m) - 1e-9:
                        continue
                    need = needed(n, m, t)
                    if min(n - p, m - pos[j]) + min(p, pos[j]) >= need and len(words(x) & words(y)) >= need:
                        gone[y] = done = True
                        break
                if done:
                    break
        for second in ahead:
            index.setdefault(second, []).append(k)


def dealt_chunk(n: int):
    return F.pmod(F.xxhash64("doc_id", F.octet_length("body")), F.lit(n)).cast("int")


def dedup_lines(docs: DataFrame, t: float = 0.8, width: int = 5, text: str = "text", id_col: str = "doc_id", chunk_bytes: int = 8 << 20, whole: int = 0) -> DataFrame:
    """`docs` without each line that has an earlier line of likeness `t` or more, kept or not; other columns unchanged.

    Earlier: a smaller id, or the same id and a smaller line number. Tokens are shingles of `width` words, or
    words for 1. Lines with fewer than `whole` words are one token, their whole sequence; other lines with fewer than `width`
    words are left alone, as are blank lines and rows without an id or a text. Rows that repeat an id and a text lose the same lines. A document whose
    every line goes keeps its row, with an empty text. `docs` is read more than once and must give the same rows in the same
    partitions and order each time, as stored tables do; store a shuffled or random frame first. Adds `removed_lines`, their numbers from 0.
    """
    n = pieces(narrow(docs, id_col, text), "octet_length(body)", chunk_bytes)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rest = [F.col(c) for c in docs.columns if c != text]
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"), F.struct(*rest).alias("rest")).withColumn("chunk", dealt_chunk(n))
    kind = dealt.schema["rest"].dataType.simpleString()
    dealt = dealt.mapInArrow(lean(packed_by_chunk), "chunk int, rows binary").repartition(n, "chunk")
    gone = later_lines(source, dealt, t, width, n, whole, chunk_bytes)

    def cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows = unpacked(texts)
        lines: dict[int, set] = {}
        for m, a in zip(replies.column("n").to_pylist(), replies.column("a").to_pylist()):
            d, k, c = (np.frombuffer(a[x * m : y * m], kind) for x, y, kind in ((0, 8, np.int64), (8, 12, np.int32), (12, 16, np.uint32)))
            for i, j, crc in zip(d.tolist(), k.tolist(), c.tolist()):
                lines.setdefault(i, set()).add((j, crc))
        kept, removed = [], []
        for d, body in zip(rows.column("doc_id").to_pylist(), rows.column("body").to_pylist()):
            own = lines.get(d)
            if not own or body is None:
                kept.append(body), removed.append([])
                continue
            parts = body.split(b"\n")
            out = {j for j, crc in own if j < len(parts) and zlib.crc32(parts[j]) == crc}
            removed.append(sorted(out)), kept.append(b"\n".join(x for j, x in enumerate(parts) if j not in out))
        return pa.table([rows.column("rest"), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.int32()))], ["rest", "kept", "removed"])

    out = dealt.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(lean(cut), f"rest {kind}, kept binary, removed array<int>")
    return out.select(*[F.col("kept").cast("string").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns], F.col("removed").alias("removed_lines"))
