"""Shared pieces of the corpus operators: reading, shared tables, word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.session import ensure_checkpoint_dir, shuffles_removed  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, body): other columns, whatever their names, stay out of the operator; a null text is null bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """`fn` over each Arrow batch; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield from (out.to_batches() if isinstance(out, pa.Table) else [out])

    return df.mapInArrow(lean(run), schema)


def give_back() -> None:
    """Hands memory that finished work has freed back to the system: a Python worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):                  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """`fn` over batches, one group or two, which gives back the memory it used when it ends."""

    def over(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    def one(t):
        try:
            return fn(t)
        finally:
            give_back()

    def two(a, b):
        try:
            return fn(a, b)
        finally:
            give_back()

    return over if inspect.isgeneratorfunction(fn) else two if len(inspect.signature(fn).parameters) == 2 else one


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo `folds`, is `fold`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def pieces(df: DataFrame, size: str, per: int, least: int = 1) -> int:
    """How many parts of about `per` bytes the column expression `size` sums up to."""
    total = df.agg(F.sum(F.expr(size)).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // per))


class WordHashes(dict):
    """Memo of 64-bit word hashes; forgets all when it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between ASCII white space start and end, in bytes that end with white space."""
    space = (text == 32) | (text - np.uint8(9) < 5)
    edge = np.flatnonzero(np.r_[True, space[:-1]] != space)
    return edge[::2], edge[1::2]


def xxh64(text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of pieces of `text`, all those of one length at once; pieces of 32 bytes or more one by one."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    left = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    eight = np.ndarray(len(text) + 1, "V8", text + bytes(8), strides=(1,))             # the eight bytes from each place on
    short = np.minimum(size, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    cuts = np.searchsorted(short[order], np.arange(33))
    out = np.empty(len(size), np.uint64)
    for n in range(32):
        own = order[cuts[n] : cuts[n + 1]]
        if not len(own):
            continue
        at, h = start[own], np.full(len(own), p5 + np.uint64(n))
        for k in range(0, n - 7, 8):
            h = left(h ^ left(eight[at + k].view("<u8") * p2, 31) * p1, 27) * p1 + p4
        tail, done = eight[at + (n & 24)].view("<u8"), 0
        if n & 4:
            h, done = left(h ^ (tail & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3, 32
        for k in range(done, (n & 7) * 8, 8):
            h = left(h ^ (tail >> np.uint64(k) & np.uint64(255)) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[own] = h ^ (h >> np.uint64(32))
    for i in order[cuts[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(text[start[i] : start[i] + size[i]], 0)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes of all k consecutive values, by doubling; fewer than k values give none."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out, done, power = len(h), None, 0, h
    width, b = 1, base
    while width <= k:
        if k & width:
            piece = power[done : done + n - k + 1]
            out = piece.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + piece
            done += width
        if width * 2 <= k:
            power = power[: len(power) - width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2
    return mixed(out)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps; each round shuffles only the edges that are left, which become stars after
    a number of rounds that grows with the logarithm of the longest path. Raises if it has not settled.
    """
    e = shared(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = shared(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = np.full(-len(v) % w, np.iinfo(v.dtype).max, v.dtype)
    block = np.concatenate([v, pad]).reshape(-1, w)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def least_gram(grams: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive gram hashes stands (the first of equals): the same place in equal windows."""
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """(doc_id, body, chunk) dealt by chunk, the number of chunks, and the bytes of all texts. Later steps reuse this exchange."""
    rows = narrow(docs)
    total = int(rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    n = max(1, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("body")), F.lit(n)).cast("int")
    return rows.withColumn("chunk", chunk).repartition(n, "chunk"), n, total


def of_chunk(t: pa.Table) -> tuple[list, list]:
    """Ids and bodies of one chunk's rows, by id and text; a null id comes last."""
    rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("body").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
    return [r[0] for r in rows], [r[1] or b"" for r in rows]


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def to_shards(order_key: np.ndarray, shards: int) -> np.ndarray:
    """Cut positions of ascending 64-bit keys into `shards` (a power of two) equal parts of the key space."""
    if shards == 1:
        return np.array([0, len(order_key)])
    at = np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - (shards.bit_length() - 1))
    return np.r_[0, np.searchsorted(order_key, at), len(order_key)]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "body") -> Iterator[pa.RecordBatch]:
    """The rows in runs of about `most_bytes` of `column`, so that working memory follows the run, or one row longer than that."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes, dtype=np.int64) - sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)
