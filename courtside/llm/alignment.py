"""Alignment of two tokenizers: groups of tokens between byte offsets where both end, and counts of the ids they link.

End offsets of both token rows are compared at the current shift of their indexes. Where they are equal, doubling steps find
how far one-to-one tokens go; where they are not, the row that is behind moves on until both end together, which is the
group, and the shift is that of its end. Both tokenizers start anew at a lone space, so the distinct words of a chunk are
encoded and aligned once, laid end to end in long rows, and a document's groups are those of its words in turn.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import narrow, shared, slices
from courtside.llm.packing import _APART


def diagonals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (i, j, n): the groups that end with tokens i, i+1, … i+n-1 of the first row and j, j+1, … of the second.

    `a` and `b` are ascending end offsets with the same last value. Within such a row all groups but the first are one-to-one.
    """
    x, y, at, bt = a.tolist(), b.tolist(), a.astype("<i8").tobytes(), b.astype("<i8").tobytes()
    out, i, j, n = [], 0, 0, len(x)
    while i < n:
        p, q = x[i], y[j]
        while p != q:
            if p < q:
                i += 1
                p = x[i]
            else:
                j += 1
                q = y[j]
        here, there, step = i + 1, j + 1, 1
        while here + step <= n and at[8 * here : 8 * (here + step)] == bt[8 * there : 8 * (there + step)]:
            here, there, step = here + step, there + step, step * 2
        while step > 1:
            step //= 2
            if here + step <= n and at[8 * here : 8 * (here + step)] == bt[8 * there : 8 * (there + step)]:
                here, there = here + step, there + step
        out.append((i, j, here - i))
        i, j = here, there
    return np.array(out, np.int64).reshape(-1, 3)


def ramps(n: np.ndarray) -> np.ndarray:
    """0 … n[0]-1, 0 … n[1]-1, …"""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Pair:
    """The two tokenizers, the bytes of their tokens and the texts of their ids."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, open(public_tokenizers.path(a).removesuffix(".json") + ".tiktoken", "rb"))}
        self.a = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.apart = not any("▁" in p.lstrip("▁") for p in names)      # no piece runs on into the next word
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.bytes_a[i] = x
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.written = [b"%d%s" % (i, end) for t, ends in ((self.bytes_a, b",|"), (self.bytes_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(len(t))]
        self.width = np.array([len(w) for w in self.written], np.int64)

    def split(self, text: str) -> list[str] | list[tuple[str]]:
        """The units of a text: its words if each space stands alone between two, as both tokenizers start anew there; else itself, in a tuple."""
        return [(text,)] if not self.apart or _APART.search(text) else text.split(" ")

    def encode(self, units: list[str | tuple[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units that both tokenizers spell, their ids of both end to end with a space before each unit, and how many each has."""
        texts = [u if isinstance(u, str) else u[0] for u in units]
        raw = [b" " + t.encode() for t in texts]
        b = self.b.encode(texts, num_threads=1)
        of = self.bytes_b.__getitem__
        spelt = [k for k, (y, r) in enumerate(zip(b, raw)) if b"".join(map(of, y)) == r]
        words = [k for k in spelt if isinstance(units[k], str)]
        rows = [self.a.encode_to_numpy(" " + " ".join([texts[k] for k in words])).astype(np.int64)] if words else []
        ends = np.searchsorted(np.cumsum(self.size_a[rows[0]]), np.cumsum([len(raw[k]) for k in words])) + 1 if words else np.zeros(0, np.int64)
        whole = [k for k in spelt if not isinstance(units[k], str)]
        rows += [self.a.encode_to_numpy(" " + texts[k]).astype(np.int64) for k in whole]
        size_a = np.r_[np.diff(ends, prepend=0), [len(x) for x in rows[bool(words) :]]].astype(np.int64)
        good = words + whole
        a = np.concatenate([np.zeros(0, np.int64), *rows])
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != b"".join([raw[k] for k in good]):
            raise ValueError("the ids of a byte-level tokenizer do not spell their text")
        size_b = np.array([len(b[k]) for k in good], np.int64)
        return np.array(good, np.int64), a, size_a, np.fromiter(chain.from_iterable([b[k] for k in good]), np.int64, int(size_b.sum())), size_b


def groups_text(pair: Pair, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of a row whose tokens are in groups `of_a` and `of_b`, and where the text of each group ends."""
    last_a, last_b = np.r_[of_a[1:] != of_a[:-1], True], np.r_[of_b[1:] != of_b[:-1], True]
    places = np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")
    word = np.empty(len(a) + len(b), np.int64)
    word[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = a + len(pair.bytes_a) * last_a
    word[places] = b + 2 * len(pair.bytes_a) + len(pair.bytes_b) * last_b
    return b"".join(map(pair.written.__getitem__, word.tolist())), np.cumsum(pair.width[word])[places[last_b]]


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ids_b: int, large: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair of ids (a * ids_b + b) and number of its links, by group.

    Groups are given by the ends of their tokens in both rows. A group of over `large` pairs gives each distinct pair once, so
    that only distinct ids are paired; others give one entry a link.
    """
    from_a, from_b = np.r_[0, cut_a[:-1]], np.r_[0, cut_b[:-1]]
    n, m = cut_a - from_a, cut_b - from_b
    usual = np.flatnonzero(n * m <= large)
    at = ramps((n * m)[usual])
    group = np.repeat(usual, (n * m)[usual])
    key, times = a[from_a[group] + at // m[group]] * ids_b + b[from_b[group] + at % m[group]], np.ones(len(at), np.int64)
    for g in np.flatnonzero(n * m > large).tolist():
        x, nx = np.unique(a[from_a[g] : cut_a[g]], return_counts=True)
        y, ny = np.unique(b[from_b[g] : cut_b[g]], return_counts=True)
        put = int(np.searchsorted(group, g))
        group = np.insert(group, put, [g] * (len(x) * len(y)))
        key = np.insert(key, put, (x[:, None] * ids_b + y).ravel())
        times = np.insert(times, put, (nx[:, None] * ny).ravel())
    return group, key, times


class Units:
    """The distinct units of a chunk of texts, aligned in long rows: counts, group texts and links of each."""

    def __init__(self, pair: Pair, units: list[str | tuple[str]], block: int = 20_000):
        n = len(units)
        self.good, self.texts, self.counts = np.zeros(n, bool), [b""] * n, np.zeros((n, 4), np.int64)
        of, keys, times = [], [], []
        for lo in range(0, n, block):
            mine, a, size_a, b, size_b = pair.encode(units[lo : lo + block])
            if not len(mine):
                continue
            mine += lo
            self.good[mine] = True
            d = diagonals(np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
            cut_a, cut_b = (np.repeat(d[:, k], d[:, 2]) + ramps(d[:, 2]) + 1 for k in (0, 1))
            of_a, of_b = (np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in (cut_a, cut_b))
            ends = np.searchsorted(cut_a, np.cumsum(size_a)) + 1                      # groups up to each unit's end
            text, at = groups_text(pair, a, b, of_a, of_b)
            for k, hi, start in zip(mine.tolist(), (at[ends - 1] - 1).tolist(), np.r_[0, at[ends[:-1] - 1]].tolist()):
                self.texts[k] = text[start:hi]
            group, key, t = links(a, b, cut_a, cut_b, len(pair.bytes_b))
            unit = np.searchsorted(ends, group, side="right")
            self.counts[mine] = np.stack([size_a, size_b, np.diff(ends, prepend=0), np.bincount(unit, t, len(mine)).astype(np.int64)], 1)
            of.append(mine[unit]), keys.append(key), times.append(t)
        self.keys, self.times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, times))
        of = np.concatenate([np.zeros(0, np.int64), *of])                             # whole texts of a block come after its words
        self.size = np.bincount(of, minlength=n)
        self.first = np.zeros(n, np.int64)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        self.first[of[start]] = start

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the units together, ascending, and how often each is linked."""
        size = self.size[units]
        at = np.repeat(self.first[units], size) + ramps(size)
        order = np.argsort(self.keys[at], kind="stable")
        key = self.keys[at][order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        return key[start], np.add.reduceat(self.times[at][order], start) if len(key) else key


ALIGNED = "chunk string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, places binary, times binary, pairs binary, docs binary"


def aligned(docs: DataFrame, a: str, b: str, keep: bool, chunk_bytes: int) -> DataFrame:
    """A row for each document, and for each chunk of about `chunk_bytes` of text one with its distinct pairs.

    A document's links are places in its chunk's ascending `pairs` and how often each is linked; `docs` says how many documents
    of the chunk hold a pair. `groups` is the groups' text, or its SHA-256 unless `keep`; it is empty without tokens.
    """
    kinds = [pa.string()] + [pa.int64()] * 5 + [pa.binary()] * 5
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches):
        pair, part, none = Pair(a, b), TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for chunk, s in enumerate(slices(batches, chunk_bytes)):
            name, rows, held, numbers = f"{part}:{chunk}", [], [], {}
            split = [pair.split(t) if t else [] for t in s.column("body").cast(pa.string()).to_pylist()]
            own = [np.array([numbers.setdefault(u, len(numbers)) for u in us], np.int64) for us in split]
            del split
            units = Units(pair, list(numbers))
            del numbers
            for doc, us in zip(s.column("doc_id").to_pylist(), own):
                if not len(us) or not units.good[us].all():
                    rows.append((name, doc, 0, 0, 0, 0, b""))
                    held.append((none, none))
                    continue
                text = b";".join([units.texts[u] for u in us.tolist()])
                rows.append((name, doc, *units.counts[us].sum(axis=0).tolist(), text if keep else hashlib.sha256(text).hexdigest().encode()))
                held.append(units.links_of(us))
            pairs, count = np.unique(np.concatenate([k for k, _ in held]), return_counts=True)
            table = [(*r, np.searchsorted(pairs, k).astype("<i4").tobytes(), t.astype("<i4").tobytes(), None, None) for r, (k, t) in zip(rows, held)]
            table.append((name, None, None, None, None, None, None, None, None, pairs.astype("<i8").tobytes(), count.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table), kinds)], names)

    return narrow(docs).mapInArrow(run, ALIGNED)


def chunk_pairs(rows: DataFrame, ids_b: int) -> DataFrame:
    """(chunk, a, b, n, place) of each distinct pair of each chunk."""

    def run(batches):
        for s in batches:
            for chunk, pairs, docs in zip(*(s.column(c).to_pylist() for c in ("chunk", "pairs", "docs"))):
                key = np.frombuffer(pairs, "<i8")
                arrays = [pa.array([chunk] * len(key), pa.string()), pa.array((key // ids_b).astype(np.int32)), pa.array((key % ids_b).astype(np.int32)), pa.array(np.frombuffer(docs, "<i8")), pa.array(np.arange(len(key), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "a", "b", "n", "place"])

    return rows.where("pairs IS NOT NULL").select("chunk", "pairs", "docs").mapInArrow(run, "chunk string, a int, b int, n long, place int")


def pair_counts(of_chunk: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold each linked pair of ids, and whether no pair of its `a` is in more.

    Chunks have counted their own documents, so even a pair of every document is a row for each chunk here.
    """
    count = of_chunk.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = count.groupBy("a").agg(F.max("n").alias("most"))
    return count.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", keep: bool = True, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row, see the contract of op12.

    Texts are encoded once, where they are read. Chunks of documents send their distinct pairs with counts, and get back the
    corpus-wide count of each; texts and tokens are never shuffled, links go as places in the chunk's list of pairs. With `keep`,
    `groups` is the text of all groups, else its SHA-256. Null and empty texts and those that a tokenizer does not spell
    have zeros and empty groups; repeated rows give a row each and count each; an empty table gives none; other columns are left out.
    """
    import public_tokenizers
    import sentencepiece

    ids_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b)).get_piece_size()
    rows = shared(aligned(docs, a, b, keep, chunk_bytes), "aligned")
    of_chunk = chunk_pairs(rows, ids_b)
    counts = shared(pair_counts(of_chunk), "pair-counts")
    back = of_chunk.select("chunk", "a", "b", "place").join(counts, ["a", "b"]).select("chunk", "place", "n", "best")

    def answer(key, left, right):
        place = right.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for places, times in zip(left.column("places").to_pylist(), left.column("times").to_pylist()):
            at, t = np.frombuffer(places, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
            sums.append((int(t @ best[at]), int(t @ n[at])))
        own = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        ends = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
        return pa.table([*own, *ends, left.column("groups").cast(pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    left = rows.where("pairs IS NULL").drop("pairs", "docs")
    return left.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(answer, schema)
