"""Suffix-array dedup: the interval tree of an enhanced suffix array gives all maximal repeats of 200 bytes or more.

Equal windows of `width` bytes have their least gram in the same place. So the windows of a text fall into segments, one
for each place where a least gram stands, and a repeated window lies in segments that share that gram. Texts are dealt once
into chunks. First each chunk sends (gram, segment hash) of its segments, every distinct one once; shards answer which
segments occur again as a whole and which must be compared. The second pass sends the bytes of only the latter, and a shard
builds over them the enhanced suffix array: suffixes in byte order, the length of the prefix each shares with the one
before, and the byte to its left. A stack scan of the shared lengths visits the tree of common-prefix intervals. An
interval whose suffixes have the same left byte is part of a longer repeat one byte to the left; one with different left
bytes is a maximal repeat, with all its occurrences. The third pass takes the covered bytes out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import chunks, least_gram, mixed, of_chunk, power_of_two, rolling, to_shards

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Segments:
    """The segments of a chunk's documents in order of gram and content, each distinct one once."""

    def __init__(self, bodies: list[bytes], width: int, gram: int, block: int = 1 << 19):
        self.bodies = bodies
        doc, a, b, at, key, content = [], [], [], [], [], []
        group, size = [], 0
        for d, body in enumerate(bodies):
            if len(body) >= width:
                group.append(d)
                size += len(body)
            if group and (size >= block or d == len(bodies) - 1):
                self._add(group, width, gram, doc, a, b, at, key, content)
                group, size = [], 0
        if group:
            self._add(group, width, gram, doc, a, b, at, key, content)
        whole = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((doc, np.int64), (a, np.int64), (b, np.int64), (at, np.int64), (key, np.uint64), (content, np.uint64))]
        order = np.lexsort((whole[5], whole[4]))
        self.doc, self.a, self.b, self.at, self.key, self.content = (x[order] for x in whole)
        k, c = self.key, self.content
        self.new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
        self.head = np.flatnonzero(self.new)
        self.run = np.cumsum(self.new) - 1
        self.count = np.bincount(self.run, minlength=len(self.head))

    def _add(self, group, width, gram, doc, a, b, at, key, content):
        text = b"".join(self.bodies[d] for d in group)
        sizes = np.array([len(self.bodies[d]) for d in group])
        first = np.r_[0, np.cumsum(sizes)]
        grams = rolling(_BYTES[np.frombuffer(text, np.uint8)], gram)
        least = least_gram(grams, width - gram + 1)
        ok = np.repeat(first[1:], sizes)[: len(least)] - np.arange(len(least)) >= width
        start = np.flatnonzero(ok)
        where = least[start]
        cut = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)])
        lo, hi, where = start[cut], start[np.r_[cut[1:] - 1, len(start) - 1]] + width, where[cut]
        d = np.searchsorted(first, lo, side="right") - 1
        digest = xxhash.xxh3_64_intdigest
        shift = where - lo                       # where the gram stands is part of what makes two segments equal
        content.append(np.fromiter((digest(text[x:y], s) for x, y, s in zip(lo.tolist(), hi.tolist(), shift.tolist())), np.uint64, len(lo)))
        doc.append(np.array(group)[d]), a.append(lo - first[d]), b.append(hi - first[d]), at.append(where - first[d]), key.append(grams[where])


def suffix_array(text: np.ndarray, start: np.ndarray, room: np.ndarray):
    """(order, shared): the suffixes at `start`, each of `room` bytes, in byte order; bytes each shares with the one before.

    Shorter comes first where one suffix is the beginning of another.
    """
    most = int(room.max())
    rows = np.zeros((len(start), most), np.uint8)
    span = np.arange(most)
    inside = span[None, :] < room[:, None]
    np.copyto(rows, text[np.minimum(start[:, None] + span, len(text) - 1)], where=inside)
    order = np.lexsort((room, rows.view(f"S{most}").ravel()))
    rows, room = rows[order], room[order]
    shared = np.zeros(len(start), np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), most) if len(start) > 1 else np.zeros(0, np.int64)
    shared[1:] = np.minimum(first, np.minimum(room[1:], room[:-1]))
    return order, shared


def maximal_repeats(shared: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, lo, hi): the intervals of the common-prefix tree of `least` bytes or more whose suffixes differ on the left.

    left: the byte before each suffix; negative values differ from everything, each other included. One scan with a stack.
    """
    out, stack = [], []
    n = len(shared)
    none = -1                                            # several different left bytes
    value = lambda i: int(left[i]) if left[i] >= 0 else none
    join = lambda p, q: p if p == q else none
    values, lengths = [value(i) for i in range(n)], shared.tolist()
    for i in range(1, n + 1):
        length = lengths[i] if i < n else 0
        lo, seen = i - 1, values[i - 1]
        while stack and stack[-1][0] > length:
            depth, lo, own = stack.pop()
            own = join(own, seen)
            if own == none:
                out.append((depth, lo, i))
            seen = own
        if length >= least:
            if stack and stack[-1][0] == length:
                stack[-1][2] = join(stack[-1][2], seen)
            else:
                stack.append([length, lo, seen])
    return out


def repeats_of(segments: list[tuple[bytes, int]], shift: np.ndarray, key: np.ndarray, width: int, most: int = 150_000):
    """Maximal repeats among segments given as (bytes, byte to the left or -1), in ascending order of `key`.

    Yields (length, [(segment, place)]). Suffixes whose first `width` bytes occur once, or always after the same byte, are
    left out first by their hashes: no maximal repeat starts there. Groups of one key are taken together, as many as
    `most` suffixes allow; a larger group is taken by the distance from the gram, which equal windows share.
    """
    n = np.array([len(s) for s, _ in segments], np.int64)
    suffixes = n - width + 1
    at = 0
    while at < len(segments):
        end, size = at, 0
        while end < len(segments) and (size < most or key[end] == key[end - 1]):
            size += int(suffixes[end])
            end += 1
        yield from _repeats(segments[at:end], shift[at:end], n[at:end], width, at)
        at = end


def _repeats(segments, shift, n, width, base):
    text = np.frombuffer(b"".join(s for s, _ in segments), np.uint8)
    first = np.r_[0, np.cumsum(n)]
    per = n - width + 1
    seg = np.repeat(np.arange(len(n)), per)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
    start = first[seg] + place
    left = np.where(place > 0, text[np.maximum(start - 1, 0)].astype(np.int64), -1)     # a segment's edge counts as different
    hashes = np.empty(len(start), np.uint64)
    step = 1 << 19
    for a in range(0, len(text), step):                                                  # hashes of the suffixes' first bytes
        own = slice(*np.searchsorted(start, [a, a + step]))
        if own.stop > own.start:
            hashes[own] = rolling(_BYTES[text[a : a + step + width]], width)[start[own] - a]
    order = np.argsort(hashes, kind="stable")
    h, lft = hashes[order], left[order]
    new = np.r_[True, h[1:] != h[:-1]]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(h)])
    diverse = (np.minimum.reduceat(lft, head) != np.maximum.reduceat(lft, head)) | (np.minimum.reduceat(lft, head) < 0)
    keep = order[np.repeat((size > 1) & diverse, size)]
    for a in _parts(shift[seg[keep]] - place[keep], h_of=hashes[keep]):
        own = keep[a]
        sa, shared = suffix_array(text, start[own], n[seg[own]] - place[own])
        ranked = own[sa]
        for length, lo, hi in maximal_repeats(shared, left[ranked], width):
            yield length, [(base + int(seg[i]), int(place[i])) for i in ranked[lo:hi]]


def _parts(distance: np.ndarray, h_of: np.ndarray, most: int = 60_000):
    """Indices in parts of about `most`, never parting suffixes with equal first bytes."""
    order = np.lexsort((h_of, distance))
    at = 0
    while at < len(order):
        end = min(len(order), at + most)
        while end < len(order) and h_of[order[end]] == h_of[order[end - 1]]:
            end += 1
        yield order[at:end]
        at = end


def _table(rows: list, names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


_NAMES, _KINDS = ["chunk", "shard", "n", "a", "b"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_ROWS = "chunk int, shard long, n long, a binary, b binary"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


class _Passes:
    def __init__(self, docs: DataFrame, width: int, gram: int, chunk_bytes: int):
        if not 0 < gram <= width:
            raise ValueError("a gram must fit into the window")
        self.width, self.gram = width, gram
        self.dealt, n, _ = chunks(docs, chunk_bytes)
        self.shards = power_of_two(n)
        self.own = self.dealt.groupBy("chunk")

    def first(self) -> DataFrame:
        width, gram, shards = self.width, self.gram, self.shards

        def hashes(t: pa.Table) -> pa.Table:
            s = Segments(of_chunk(t)[1], width, gram)
            key, content, cuts = s.key[s.head], s.content[s.head], to_shards(s.key[s.head], shards)
            chunk = t.column("chunk")[0].as_py()
            rows = [(chunk, k, int(b - a), key[a:b].tobytes() + content[a:b].tobytes(), _bits(s.count[a:b] > 1)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return _table(rows, _NAMES, _KINDS)

        def judge(t: pa.Table) -> pa.Table:
            sizes = t.column("n").to_pylist()
            parts = [np.frombuffer(a, np.uint64) for a in t.column("a").to_pylist()]
            key = np.concatenate([p[:n] for p, n in zip(parts, sizes)])
            content = np.concatenate([p[n:] for p, n in zip(parts, sizes)])
            twice = np.concatenate([_flags(b, n) for b, n in zip(t.column("b").to_pylist(), sizes)])
            order = np.lexsort((content, key))
            k, c = key[order], content[order]
            new_key = np.r_[True, k[1:] != k[:-1]]
            new = new_key | np.r_[True, c[1:] != c[:-1]]
            run = np.cumsum(new) - 1
            times = np.bincount(run, 1 + twice[order])[run]                    # of this segment
            group = np.cumsum(new_key) - 1
            kinds = np.bincount(group, new)[group]                              # different segments of this gram
            whole, send = np.zeros(len(key), bool), np.zeros(len(key), bool)
            whole[order] = times > 1
            send[order] = new & (kinds > 1)
            rows, at = [], 0
            for chunk, shard, n in zip(t.column("chunk").to_pylist(), t.column("shard").to_pylist(), sizes):
                w, s = whole[at : at + n], send[at : at + n]
                if w.any() or s.any():
                    rows.append((chunk, shard, n, _bits(w), _bits(s)))
                at += n
            return _table(rows, _NAMES, _KINDS)

        return self.own.applyInArrow(hashes, _ROWS).groupBy("shard").applyInArrow(judge, _ROWS)

    def to_compare(self, first: DataFrame) -> DataFrame:
        """(chunk, shard, n, a, b): of each shard's segments to compare, numbers in `a` and bytes in `b`."""
        width, gram, shards = self.width, self.gram, self.shards

        def send(t: pa.Table, replies: pa.Table) -> pa.Table:
            if not t.num_rows or not replies.num_rows:
                return _table([], _NAMES, _KINDS)
            s = Segments(of_chunk(t)[1], width, gram)
            cuts, rows, chunk = to_shards(s.key[s.head], shards), [], t.column("chunk")[0].as_py()
            for shard, n, b in zip(*(replies.column(c).to_pylist() for c in ("shard", "n", "b"))):
                entry = np.flatnonzero(_flags(b, n))
                if not len(entry):
                    continue
                i = s.head[cuts[shard] + entry]
                texts = [s.bodies[d][a:e] for d, a, e in zip(s.doc[i].tolist(), s.a[i].tolist(), s.b[i].tolist())]
                left = [s.bodies[d][a - 1] if a else -1 for d, a in zip(s.doc[i].tolist(), s.a[i].tolist())]
                numbers = np.stack([s.key[i].view(np.int64), entry, s.at[i] - s.a[i], np.array([len(x) for x in texts]), np.array(left)]).astype(np.int64)
                rows.append((chunk, shard, len(entry), numbers.tobytes(), b"".join(texts)))
            return _table(rows, _NAMES, _KINDS)

        return self.own.cogroup(first.groupBy("chunk")).applyInArrow(send, _ROWS)


def _received(t: pa.Table):
    """Segments of a shard in order of gram: (bytes, left), shift, key, chunk, entry."""
    texts, left, shift, key, chunk, entry = [], [], [], [], [], []
    for c, n, a, b in zip(*(t.column(x).to_pylist() for x in ("chunk", "n", "a", "b"))):
        k, e, s, size, lft = np.frombuffer(a, np.int64).reshape(5, n)
        cut = np.r_[0, np.cumsum(size)].tolist()
        texts += [b[x:y] for x, y in zip(cut, cut[1:])]
        left.append(lft), shift.append(s), key.append(k.view(np.uint64)), chunk.append(np.full(n, c)), entry.append(e)
    left, shift, key, chunk, entry = map(np.concatenate, (left, shift, key, chunk, entry))
    order = np.argsort(key, kind="stable")
    return [(texts[i], int(left[i])) for i in order.tolist()], shift[order], key[order], chunk[order], entry[order]


def remove_repeated(docs: DataFrame, width: int = 200, gram: int = 64, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: texts are bytes, null is empty, and matches never cross rows.

    removed: the maximal stretches (start, length) of bytes covered by a string of `width` bytes that also starts anywhere
    else, the same row included, judged on the input; kept: the other bytes. Repeated rows are occurrences of each other.
    """
    passes = _Passes(docs, width, gram, chunk_bytes)
    shards = passes.shards
    first = passes.first()

    def compare(t: pa.Table) -> pa.Table:
        segments, shift, key, chunk, entry = _received(t)
        stretches: dict[int, list[tuple[int, int]]] = {}
        for length, places in repeats_of(segments, shift, key, width):
            for i, place in places:
                stretches.setdefault(i, []).append((place, place + length))
        by_chunk: dict[int, list] = {}
        for i, own in stretches.items():
            merged, end = [], -1
            for x, y in sorted(own):
                if x > end:
                    merged.append([x, y])
                elif y > merged[-1][1]:
                    merged[-1][1] = y
                end = merged[-1][1]
            by_chunk.setdefault(int(chunk[i]), []).extend((int(entry[i]), x, y) for x, y in merged)
        shard = t.column("shard")[0].as_py()
        return _table([(c, -1 - shard, len(x), np.array(x, np.int32).tobytes(), b"") for c, x in by_chunk.items()], _NAMES, _KINDS)

    second = passes.to_compare(first).groupBy("shard").applyInArrow(compare, _ROWS)
    gram = passes.gram

    def cut(t: pa.Table, replies: pa.Table) -> pa.Table:
        ids, bodies = of_chunk(t)
        s = Segments(bodies, width, gram)
        cuts, spans = to_shards(s.key[s.head], shards), [[] for _ in bodies]
        whole = np.zeros(len(s.head), bool)
        later = []
        for shard, n, a in zip(*(replies.column(c).to_pylist() for c in ("shard", "n", "a"))):
            if shard >= 0:
                whole[cuts[shard] : cuts[shard] + n] = _flags(a, n)
            else:
                later.append((cuts[-1 - shard], np.frombuffer(a, np.int32).reshape(-1, 3)))
        i = np.flatnonzero(whole[s.run]) if len(s.run) else np.zeros(0, np.int64)
        for d, x, y in zip(s.doc[i].tolist(), s.a[i].tolist(), s.b[i].tolist()):
            spans[d].append((x, y))
        for base, rows in later:
            for e, x, y in rows.tolist():
                if not whole[base + e]:
                    j = s.head[base + e]
                    spans[int(s.doc[j])].append((int(s.a[j]) + x, int(s.a[j]) + y))
        removed, kept = [], []
        for body, own in zip(bodies, spans):
            merged = []
            for x, y in sorted(own):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(y, merged[-1][1])
                else:
                    merged.append([x, y])
            edges = [0, *(z for m in merged for z in m), len(body)]
            kept.append(b"".join(body[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            removed.append([{"start": x, "length": y - x} for x, y in merged])
        return pa.table([pa.array(ids, pa.int64()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    right = first.unionByName(second).groupBy("chunk")
    return passes.own.cogroup(right).applyInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start: int, length: int>>, kept binary")


def repeat_groups(docs: DataFrame, width: int = 200, gram: int = 64, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(shard, repeat, length, chunk, segment, place): each maximal repeat among compared segments with all its occurrences.

    Repeats are maximal within their segments; an occurrence is a place in a chunk's segment, which stands for all rows
    with that segment.
    """
    passes = _Passes(docs, width, gram, chunk_bytes)

    def groups(t: pa.Table) -> pa.Table:
        segments, shift, key, chunk, entry = _received(t)
        shard, rows = t.column("shard")[0].as_py(), []
        for number, (length, places) in enumerate(repeats_of(segments, shift, key, width)):
            rows += [(shard, number, length, int(chunk[i]), int(entry[i]), p) for i, p in places]
        return _table(rows, ["shard", "repeat", "length", "chunk", "segment", "place"], [pa.int64()] * 6)

    schema = "shard long, repeat long, length long, chunk long, segment long, place long"
    return passes.to_compare(passes.first()).groupBy("shard").applyInArrow(groups, schema)
