"""Benchmark decontamination: suffix arrays of training shards, searched for every suffix of the test texts.

A shard is a batch of whole documents. Its suffix array holds, in sorted order, the suffixes that can match: those whose
first words are all words of some test text. Each test suffix is found by binary search, which gives the places of its
window; places are then followed as far as the words stay equal, which gives the longest verbatim match there. Test texts
come in blocks of bounded size; a shard never leaves its task, so nothing is shuffled but the matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import lean, narrow, shared

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(_LOWER).split()


class TestSuffixes:
    """Word numbers of a block of test texts, and every suffix that opens a window."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int):
        self.width, self.number, self.windows, sequences, owner = width, {}, {}, [], []
        for k, (_, body) in enumerate(items):
            words = words_of(body)
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            sequences.append(np.array(ids, np.int64))
            owner.append(k)
        self.sequences = sequences
        keys: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, s in zip(owner, sequences):
            m = min(width, len(s))
            for at in range(len(s) - m + 1 if m else 0):
                keys.setdefault(m, {}).setdefault(self.pack(s[at : at + m]), []).append((k, at))
        self.keys = {m: (np.array(sorted(v), f"S{4 * m}"), [v[x] for x in sorted(v)]) for m, v in keys.items()}
        self.least = min(keys, default=width)

    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        """Big-endian numbers with no zero bytes: their byte order is the order of the word sequences."""
        out = np.empty((len(ids), 4), np.uint8)
        v = np.asarray(ids, np.int64)
        for j in range(4):
            out[:, 3 - j] = v % 255 + 1
            v = v // 255
        return out.tobytes()


class Shard:
    """Suffix array over the words of some documents; number 0 is a word of no test text and ends every match."""

    def __init__(self, bodies: list[bytes | None], tests: TestSuffixes):
        get = tests.number.get
        parts, self.sizes = [], []
        for body in bodies:
            words = words_of(body)
            self.sizes.append(len(words))
            parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.first = np.cumsum([0] + [n + 1 for n in self.sizes[:-1]])
        n, w = len(self.ids), tests.width
        stop = np.where(self.ids == 0, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
        self.run = stop - np.arange(n)                     # words from here on that some test text has
        at = np.flatnonzero(self.run >= tests.least)
        packed = np.frombuffer(tests.pack(self.ids), np.uint8).reshape(-1, 4) if n else np.zeros((0, 4), np.uint8)
        prefix = np.zeros((len(at), w, 4), np.uint8)
        for j in range(w):
            inside = self.run[at] > j
            prefix[inside, j] = packed[at[inside] + j]
        prefix = np.ascontiguousarray(prefix.reshape(len(at), 4 * w)).view(f"S{4 * w}").ravel()
        order = np.argsort(prefix, kind="stable")
        self.suffixes, self.prefixes = at[order], prefix[order]

    def occurrences(self, tests: TestSuffixes):
        """(place, window length, [(item, place in item)]) of each occurrence of each window."""
        for m, (keys, where) in tests.keys.items():
            lo = np.searchsorted(self.prefixes, keys, side="left")
            hi = np.searchsorted(self.prefixes, np.array([k + b"\xff" * (4 * (tests.width - m)) for k in keys.tolist()], f"S{4 * tests.width}"), side="right") if m < tests.width else np.searchsorted(self.prefixes, keys, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                for place in self.suffixes[lo[k] : hi[k]].tolist():
                    yield place, m, where[k]

    def longest(self, place: int, tests: TestSuffixes, item: int, at: int) -> int:
        s = tests.sequences[item]
        n = min(int(self.run[place]), len(s) - at)
        differ = np.flatnonzero(self.ids[place : place + n] != s[at : at + n])
        return int(differ[0]) if differ.size else n


_MATCHES = "doc_id long, n_words long, words_hit array<struct<a: int, b: int>>, items array<string>, matches array<struct<item_id: string, item_start: int, start: int, length: int>>"


def search(docs: DataFrame, benchmark: list[tuple[object, bytes | None]], width: int = 10, shard_bytes: int = 4 << 20) -> DataFrame:
    """Of every document: its words, hit stretches, items found, and longest matches (from where both go on no further left)."""
    names = [str(i) for i, _ in benchmark]
    held = docs.sparkSession.sparkContext.broadcast(benchmark)

    def run(batches):
        tests = TestSuffixes(held.value, width)
        for b in batches:
            ids, bodies, done = b.column("doc_id").to_pylist(), b.column("body").to_pylist(), 0
            while done < len(ids):
                end, size = done, 0
                while end < len(ids) and (end == done or size < shard_bytes):
                    size += len(bodies[end] or b"")
                    end += 1
                shard = Shard(bodies[done:end], tests)
                found: dict[int, tuple[list, set, list]] = {}
                for place, m, items in shard.occurrences(tests):
                    d = int(np.searchsorted(shard.first, place, side="right")) - 1
                    start = place - int(shard.first[d])
                    spans, own, matches = found.setdefault(d, ([], set(), []))
                    spans.append((start, start + m))
                    for item, at in items:
                        own.add(names[item])
                        if not at or not start or shard.ids[place - 1] != tests.sequences[item][at - 1]:
                            matches.append({"item_id": names[item], "item_start": at, "start": start, "length": shard.longest(place, tests, item, at)})
                rows = [found.get(d, ((), (), ())) for d in range(end - done)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[done:end], pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array([[{"a": x, "b": y} for x, y in merged(r[0])] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                     pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string())), pa.array([list(r[2]) for r in rows], pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])))],
                    ["doc_id", "n_words", "words_hit", "items", "matches"])
                done = end

    return narrow(docs).mapInArrow(lean(run), _MATCHES)


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[object, bytes | None]]]:
    """The test texts in blocks of about `block_bytes`: one block is held at a time, by the driver and in each task."""
    out, size = [[]], 0
    for r in benchmark.select(F.col("item_id"), F.col("text").cast("string").cast("binary").alias("body")).toLocalIterator():
        if size > block_bytes:
            out.append([])
            size = 0
        out[-1].append((r["item_id"], bytes(r["body"]) if r["body"] is not None else None))
        size += len(r["body"] or b"") + 16
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, items, matches) of every row of `docs`.

    A test text of fewer than `width` words is one window; one without words, or null, has none. Words are hit if any
    occurrence of a window covers them. Blocks beyond the first are searched one by one and joined by document; the same
    id on several rows then needs rows that are told apart, so each row gets a number when there are more blocks.
    """
    parts = blocks(benchmark, block_bytes)
    count = F.aggregate("words_hit", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    if len(parts) == 1:
        return search(docs, parts[0], width).select("doc_id", "n_words", count.alias("n_hit"), "items", "matches")
    rows = shared(narrow(docs).withColumn("row", F.monotonically_increasing_id()), "documents")
    numbered = rows.select(F.col("row").alias("doc_id"), F.col("body").cast("string").alias("text"))
    found = None
    for block in parts:
        more = shared(search(numbered, block, width).where("size(items) > 0"), "matches")
        found = more if found is None else found.unionByName(more)
    words = search(numbered, [], width).select(F.col("doc_id").alias("row"), "n_words")
    spans = found.select(F.col("doc_id").alias("row"), "words_hit", "items", "matches")
    per = spans.groupBy("row").agg(F.flatten(F.collect_list("words_hit")).alias("words_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("words_hit", lambda s: F.sequence(s["a"], s["b"] - 1))))).cast("long")
    per = per.select("row", hit.alias("n_hit"), "items", "matches")
    none = F.array().cast("array<string>")
    return rows.select("row", "doc_id").join(words, "row").join(per, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without a hit, with all their columns."""
    hit = decontaminate(docs, benchmark, width).where("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")
