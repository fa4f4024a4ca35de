"""Stateful processors over snapshots that may arrive late or out of order.

Rows wait in state until the watermark has passed their time, and are judged then, in order of event time; so the order of
arrival within the allowed delay changes nothing. Rows that come after that are written to an output of their own, none is
dropped. A state key is a hash bucket of ids: state holds what still waits, and the last known value of each id. The state
store is RocksDB, so state need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from courtside.functions import lookups as lk
from courtside.operators import alerts as al

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "kind string, at long, id string, ordinal long, signature string"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
ON_TIME, LATE = "on_time", "late"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({"at": "Int64", "ordinal": "Int64"})


class Transitions(StatefulProcessor):
    """Ids that are hits in a snapshot and were none in the snapshot before it, as snapshots become final.

    A row without an id says that its snapshot was delivered; each bucket hears of every snapshot that way, also of one that
    has no hits for it. State: hits of the snapshots that wait, and those of the last final one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "ids array<string>")
        self.last = handle.getValueState("last", "ids array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            for at, own in part.groupby("at"):
                at, ids = int(at), own["id"].dropna().tolist()
                if at <= passed:
                    late += [(LATE, at, i, None, None) for i in ids or [None] * (key[0] == 0)]     # a late delivery itself: told once
                    continue
                held = list(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
                self.waiting.updateValue((at,), (sorted({*held, *ids}),))
                self.handle.registerTimer(at)
        if late:
            yield frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = set(self.last.get()[0]) if self.last.exists() else set()
        out = []
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= passed):
            ids = list(self.waiting.getValue((at,))[0])
            out += [(ON_TIME, at, i, None, None) for i in ids if i not in last]
            last = set(ids)
            self.last.update((ids,))
            self.waiting.removeKey((at,))
        if out:
            yield frame(out)

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Rows whose signature differs from the one before it of their id, by ordinal; a first sight is no change.

    Rows wait by hour. An id not heard of for `idle_ms` is forgotten, its next row is a first sight again. State: rows of the
    hours that wait, the last signature of each id, and when it was heard of.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long", "ids array<string>, ordinals array<long>, signatures array<string>")
        self.last = handle.getMapState("last", "id string", "signature string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            part = part[part["id"].notna()]
            part = part.assign(hour=(part["at"] // 3_600_000 + 1) * 3_600_000)
            old = part["hour"] <= passed
            late += [(LATE, int(a), i, int(o), s) for a, i, o, s in part.loc[old, ["at", "id", "ordinal", "signature"]].itertuples(index=False)]
            for hour, own in part[~old].groupby("hour"):
                hour, new = int(hour), (own["id"].tolist(), [int(o) for o in own["ordinal"]], own["signature"].tolist())
                if self.waiting.containsKey((hour,)):
                    new = tuple([*h, *n] for h, n in zip(self.waiting.getValue((hour,)), new))
                self.waiting.updateValue((hour,), new)
                self.handle.registerTimer(hour)
        if late:
            yield frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        hours = sorted(k[0] for k in self.waiting.keys() if k[0] <= passed)
        last = {k[0]: tuple(v) for k, v in self.last.iterator()} if hours else {}
        before = dict(last)
        for hour in hours:
            for ordinal, i, s in sorted(set(zip(*(self.waiting.getValue((hour,))[k] for k in (1, 0, 2))))):
                known = last.get(i)
                if known and hour - known[1] <= self.idle_ms and known[0] != s:
                    out.append((ON_TIME, hour, i, ordinal, s))
                last[i] = (s, hour)
            self.waiting.removeKey((hour,))
        for i, value in last.items():
            if passed - value[1] > self.idle_ms:
                if i in before:
                    self.last.removeKey((i,))
            elif before.get(i) != value:
                self.last.updateValue((i,), value)
        if out:
            yield frame(out)

    def close(self) -> None:
        pass


def with_deliveries(snapshots: DataFrame) -> DataFrame:
    """Rows of snapshots, and for each snapshot one without an id that says it was delivered."""
    said = snapshots.select("snapshot_at").distinct()
    return snapshots.unionByName(said, allowMissingColumns=True)


def by_time(stream: DataFrame, delay: str, *columns: Column) -> DataFrame:
    """The columns and `at`, milliseconds of `snapshot_at`, under a watermark of `delay`.

    The column that carries the watermark stays behind: Spark would drop late rows by it, which here go to the late output.
    """
    timed = stream.withColumn("_time", F.col("snapshot_at").cast("timestamp")).withWatermark("_time", delay)
    return timed.select(*columns, F.unix_millis("_time").alias("at"))


def bucket_of(ids: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def write(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """On-time and late rows in a folder each, one folder per epoch: an epoch that runs again writes the same rows."""

    def put(batch: DataFrame, epoch: int) -> None:
        at = F.timestamp_millis("at").cast("timestamp_ntz").alias("snapshot_at")
        batch = batch.persist()
        for kind in (ON_TIME, LATE):
            batch.where(F.col("kind") == kind).select(at, "id", "ordinal", "signature").write.mode("overwrite").parquet(f"{out}/{kind}/epoch={epoch}")
        batch.unpersist()

    with rocksdb(results.sparkSession):
        return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transitions_stream(snapshots: DataFrame, hit: Column, out: str, checkpoint: str, delay: str = "2 days", buckets: int = 64) -> StreamingQuery:
    """Entries into `hit`, per snapshot; `snapshots` holds a row without an id for each delivery, see with_deliveries.

    A snapshot is judged once the newest one is later by more than `delay`; then its late rows, and late snapshots, go to `out`/late.
    Snapshots may be spread over micro-batches in any way.
    """
    own = F.when(F.col("id").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(bucket_of(F.col("id"), buckets)))
    rows = by_time(snapshots.where(F.col("id").isNull() | hit), delay, F.explode(own).alias("bucket"), F.col("id").cast("string").alias("id"))
    return write(rows.groupBy("bucket").transformWithStateInPandas(Transitions(), RESULT, "append", "EventTime"), out, checkpoint)


def live_transitions_stream(snapshots: DataFrame, out: str, checkpoint: str, delay: str = "2 days", buckets: int = 64) -> StreamingQuery:
    """Matches that become live."""
    return transitions_stream(snapshots, F.col("status") == lk.LIVE, out, checkpoint, delay, buckets)


def soon_transitions_stream(snapshots: DataFrame, out: str, checkpoint: str, delay: str = "2 days", buckets: int = 64) -> StreamingQuery:
    """Upcoming matches that enter the lead window."""
    hit = (F.col("status") == lk.UPCOMING) & al.within_lead(F.col("est_start_at"), F.col("snapshot_at"))
    return transitions_stream(snapshots, hit, out, checkpoint, delay, buckets)


def score_changes_stream(polls: DataFrame, out: str, checkpoint: str, delay: str = "2 days", idle: str = "60 days", buckets: int = 64) -> StreamingQuery:
    """Score changes of polls (id, ordinal, snapshot_at, signature); rows without a signature change nothing.

    A row without an id tells the time only. `idle` bounds the state: an id not polled for that long is forgotten.
    """
    signed = polls.where("signature IS NOT NULL OR id IS NULL")
    idle_ms = int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))
    rows = by_time(signed, delay, bucket_of(F.col("id"), buckets).alias("bucket"), F.col("id").cast("string").alias("id"), F.col("ordinal").cast("long").alias("ordinal"), "signature")
    return write(rows.groupBy("bucket").transformWithStateInPandas(Changes(idle_ms), RESULT, "append", "EventTime"), out, checkpoint)


def results(spark: SparkSession, out: str, kind: str = ON_TIME) -> DataFrame:
    """What a stream has written: (snapshot_at, id, ordinal, signature) on time, or late."""
    schema = "snapshot_at timestamp_ntz, id string, ordinal long, signature string"
    return spark.read.schema(schema).parquet(f"{out}/{kind}")
