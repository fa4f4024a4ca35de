"""Best-fit packing by minimum bin slack: tokenised documents into full sequences.

A plan is made over the histogram of piece lengths, which has at most `capacity` entries however large the corpus is; the
pieces themselves are ranked within their length and take their place in the plan by that rank, on the executors.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import by_batch, lean, narrow, shared

_APART = re.compile(r"^\s|\s$|\s\s")          # white space that does not stand alone between two other characters


class WordTokens:
    """Ids of whole texts by the byte-level BPE file at `path(name)`, as bytes of little-endian unsigned 32-bit numbers.

    A lone space between two words always starts a token, so words are encoded once each and remembered (at most `most`).
    Texts with other white space beside white space are encoded whole. Special tokens in a text count as such.
    """

    def __init__(self, name: str, most: int = 200_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        special = {t.content: i for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items() if t.special}
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        self.encoder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.spaced = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.known, self.most = {}, most

    def whole(self, text: str) -> bytes:
        return self.encoder.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t is None or _APART.search(t) else t.split(" ") for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        missing = {w for ws in split if ws for w in ws[1:] if w not in known}
        if missing:
            words = list(missing)
            ids = self.encoder.encode_to_numpy(" " + " ".join(words), allowed_special="all").astype("<u4")
            cuts = (np.flatnonzero(self.spaced[ids]) * 4).tolist() + [len(ids) * 4]
            assert len(cuts) == len(words) + 1
            data = ids.tobytes()
            known.update(zip(words, (data[a:b] for a, b in zip(cuts, cuts[1:]))))
        get = known.__getitem__
        return [b"" if not t else self.whole(t) if ws is None else self.whole(ws[0]) + b"".join(map(get, ws[1:])) for t, ws in zip(texts, split)]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full pieces after a first that takes the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, name: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, group: int = 400, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; null text is empty and has only its end id."""

    def run(batches):
        words, end = WordTokens(name), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, group):
                part = b.slice(at, group)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), words.many(part.column("text").to_pylist())):
                    ids += end
                    rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), ids[4 * s : 4 * (s + n)] if keep_ids else None) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                d, k, s, n, c, i = zip(*rows)
                arrays = [pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())] + [pa.array(i, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    text = narrow(docs).select("doc_id", F.col("body").cast("string").alias("text"))
    return text.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, copies) of the available lengths whose sum comes nearest to `room` without passing it.

    Bit s of `reach` is set if some choice sums to s. Longer lengths come first, and it ends when `room` itself is reached.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, k = min(int(counts[length]), room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            used[length] = used.get(length, 0) + k
    return list(used.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (pieces by length, how many such bins): the longest piece left, then the fullest feasible combination.

    A combination is taken as often as the counts allow, so the number of entries depends on `capacity`, not on the corpus.
    """
    counts, bins = np.zeros(capacity + 1, np.int64), []
    for length, n in histogram.items():
        counts[length] = n
    while (there := np.flatnonzero(counts)).size:
        longest = int(there[-1])
        counts[longest] -= 1
        used = {longest: 1}
        for length, k in fullest(counts, capacity - longest) if longest < capacity else []:
            used[length] = used.get(length, 0) + k
        counts[longest] += 1
        times = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        bins.append((sorted(used.items(), reverse=True), times))
    return bins


def pack(pieces: DataFrame, capacity: int = 2048, salts: int = 128, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (with a `length` from 1 to `capacity`) with sequence_id and offset; ties in the keys get places of their own.

    Ranks within a length are counted per salt first, so a length that most pieces have still spreads over `salts` tasks.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = shared(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}   # at most `capacity` rows
    lo, width, first, offset, step, taken, sequence = [], [], [], [], [], {}, 0
    for used, times in plan(histogram, capacity):
        place = 0
        for length, k in used:
            at = taken.get(length, 0)
            lo.append((length << 44) + at)
            width.append(k), first.append(sequence), offset.append(place), step.append(at)
            taken[length] = at + k * times
            place += length * k
        sequence += times
    order = np.argsort(np.array(lo, np.int64), kind="stable")
    arrays = [np.array(v, np.int64)[order] for v in (lo, width, first, offset, step)]
    held = pieces.sparkSession.sparkContext.broadcast(arrays)             # some thousand entries at most, see plan()
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0))).select(*pieces.columns, F.col("_rank").cast("long"))

    def place_of(b: pa.RecordBatch) -> pa.RecordBatch:
        lo, width, first, offset, step = held.value
        length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
        i = np.searchsorted(lo, (length << 44) + rank, side="right") - 1
        j = rank - step[i]
        names = [c for c in b.schema.names if c != "_rank"]
        return pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(first[i] + j // width[i]), pa.array(offset[i] + j % width[i] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return by_batch(ranked, place_of, schema)


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k.json", capacity: int = 2048) -> DataFrame:
    """Every document's pieces with their places. An empty table gives no rows; repeated rows are packed each."""
    return pack(shared(tokenised(docs, name, capacity), "pieces"), capacity)
