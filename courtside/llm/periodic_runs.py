"""Periodic runs of words: maximal pairs of an LCP-interval tree whose distance fits their common prefix.

Two places of a document that share exactly `l` words, at distance `d <= l`, with different words before them, bound a stretch
of d + l words of period d that no neighbour extends; every run is such a pair at its smallest period. Pairs are read off the
tree of common-prefix intervals from the bottom up: a node holds its places by the word before them, and where two children
meet, only places of other words within `l` of each other are looked at. No stretch is extended word by word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courtside.llm.common import mixed, narrow, rolling, slices


class Numbers(dict):
    """Numbers words from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def repeated_grams(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` words from each place stand elsewhere in its document too (equal hashes count, which adds places at most)."""
    out = np.zeros(len(ids), bool)
    if len(ids) < width:
        return out
    inside = np.flatnonzero(doc[: len(ids) - width + 1] == doc[width - 1 :])
    key = mixed(rolling(mixed(ids.astype(np.uint64)), width)[inside] ^ mixed(doc[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out[inside[order[1:][same]]] = out[inside[order[:-1][same]]] = True
    return out


def suffix_order(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places ordered by document, then by the words from there to the document's end; by doubling, ties only."""
    n, key = len(ids), doc * (int(ids.max()) + 1) + ids
    order, rank, width = np.argsort(key, kind="stable"), np.zeros(n, np.int64), 1
    slots, value = np.arange(n), key[order]
    while True:
        first = np.r_[True, (value[1:] != value[:-1]) | (slots[1:] != slots[:-1] + 1)]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))] + 1
        alone = first & np.r_[first[1:], True]
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        after = at + width
        follow = np.where(after < end[at], rank[np.minimum(after, n - 1)], 0)
        value = rank[at] * (n + 2) + follow
        by = np.argsort(value, kind="stable")
        order[slots], value, width = at[by], value[by], width * 2


def common_prefixes(words: list[int], places: list[int], before: dict[int, int], end: int, width: int) -> dict[int, int]:
    """Words that each of the ascending `places` shares with the place `before` it in suffix order.

    The next place shares at least one word less, if that still is `width`: then both places after the two are among `places`.
    """
    out, h, last = {}, 0, -2
    for i in places:
        h = h - 1 if h > width and i == last + 1 else 0
        last, j = i, before[i]
        most = end - max(i, j)
        while h < most and words[i + h] == words[j + h]:
            h += 1
        out[i] = h
    return out


class Node:
    """Places of an interval, ascending, and the same by the word before them."""

    __slots__ = ("places", "by_word")

    def __init__(self, place: int, word: int):
        self.places, self.by_word = [place], {word: [place]}


def meet(a: Node, b: Node, shared: int, left: list[int], out: list[tuple[int, int, int]]) -> Node:
    """Writes the pairs between two children of an interval of `shared` words to `out`, and joins the smaller into the larger."""
    if len(a.places) < len(b.places):
        a, b = b, a
    for word, places in b.by_word.items():
        for p in places:
            lo, hi = bisect_left(a.places, p - shared), bisect_right(a.places, p + shared)
            if lo == hi:
                continue
            if hi - lo <= len(a.by_word):
                out += [(min(p, x), shared + abs(x - p), abs(x - p)) for x in a.places[lo:hi] if left[x] != word]
            else:
                for other, xs in a.by_word.items():
                    if other != word:
                        out += [(min(p, x), shared + abs(x - p), abs(x - p)) for x in xs[bisect_left(xs, p - shared) : bisect_right(xs, p + shared)]]
    for p in b.places:
        insort(a.places, p)
    for word, places in b.by_word.items():
        if word in a.by_word:
            for p in places:
                insort(a.by_word[word], p)
        else:
            a.by_word[word] = places
    return a


def maximal_pairs(order: list[int], shared: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place, words of the stretch, distance) of maximal pairs no farther apart than the words they share, `least` or more of these.

    `order` holds places in suffix order, `shared` the words each has in common with the one before, `left` the word before a
    place (0 at the start). Intervals close from the bottom up; as distances are bounded, the pairs number no more than the
    document's words a few times over, however often a word repeats.
    """
    out, open_, node = [], [], None
    for place, h in zip([*order, None], [*shared, 0]):
        h = h if h >= least else 0
        while open_ and open_[-1][0] > h:
            level, other = open_.pop()
            node = meet(other, node, level, left, out)
        if h and open_ and open_[-1][0] == h:
            open_[-1][1] = meet(open_[-1][1], node, h, left, out)
        elif h:
            open_.append([h, node])
        if place is not None:
            node = Node(place, left[place])
    return out


def runs_of(docs: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each word list, by start, then period. A run has twice its period and `least` words or more."""
    numbers, found = Numbers(), [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.fromiter((numbers[w] for d in docs for w in d), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(docs)), sizes)
    half = max(1, -(-least // 2))
    again = repeated_grams(ids, doc, half)
    some = np.zeros(len(docs), bool)
    some[doc[again]] = True
    ids, again, keep = ids[some[doc]], again[some[doc]], np.flatnonzero(some)
    if not len(keep):
        return found
    ends = np.cumsum(sizes[keep])
    doc = np.repeat(np.arange(len(keep)), sizes[keep])
    order = suffix_order(ids, doc, ends[doc])
    first = np.r_[0, ends[:-1]]
    for k, d in enumerate(keep.tolist()):
        lo, hi = int(first[k]), int(ends[k])
        own = order[lo:hi]
        mine = (own[again[own]] - lo).tolist()
        words = ids[lo:hi].tolist()
        before = dict(zip(mine[1:], mine))
        head = mine[0]
        shared = common_prefixes(words, sorted(mine[1:]), before, hi - lo, half) | {head: 0}
        best: dict[tuple[int, int], int] = {}
        for start, length, period in maximal_pairs(mine, [shared[i] for i in mine], [0, *words], half):
            if length >= least and best.get((start, length), length) > period:
                best[start, length] = period
        found[d] = sorted((s, n, p) for (s, n), p in best.items())
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = 12, alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs of `least` words or more, and its text with each run cut to one period.

    Words are what white space of ASCII parts; `alter` may replace the words of a document first. Nothing is shuffled: documents
    are searched where they are read, some megabytes at a time, a longer one alone. A null text has no words; repeated rows give
    a row each, an empty table none; other columns are left out, whatever their names.
    """

    def run(batches):
        for b in slices(batches, slice_bytes):
            ids = b.column("doc_id").to_pylist()
            words = [(t or b"").split() for t in b.column("body").to_pylist()]
            if alter:
                words = [alter(d, w) for d, w in zip(ids, words)]
            found = runs_of(words, least)
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in found])], pa.int32())
            arrays = [
                pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, struct),
                pa.array([collapse(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    return narrow(docs).mapInArrow(run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period; null without runs) and hashes of the rows of `periodic_runs`."""
    longest = "array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))"
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    return found.selectExpr("*", f"{longest} AS _top").selectExpr(
        "doc_id", "cast(size(runs) AS long) AS n_runs", "-_top.start AS start", "_top.length AS length", "-_top.period AS period",
        "(1000 * _top.length) div -_top.period AS exponent_milli",
        f"sha2(cast({lines} AS binary), 256) AS runs_sha256", "sha2(cast(collapsed AS binary), 256) AS collapsed_sha256", "n_words",
    )
