"""Structured Streaming forms of the snapshot operators.

Streams carry rows of snapshots or deliveries. State that must be compared with the next
arrival lives in keyed tables under a state folder (shared storage on a cluster), split
into hash buckets so that a micro-batch rewrites only the buckets it touches. Every merge
is decided by event order, so replaying a micro-batch after a failure changes nothing.
Transitions and score changes keep state per key in the state store instead: see keyed.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from courtside.functions.dates import iso_week
from courtside.operators import alerts as al, feed as fd, rankings as rk
from courtside.operators.ordered import best_row
from courtside.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_state(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A state table, or an empty one of the same shape before the first batch."""
    if not exists(spark, path):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def start(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- keyed upserts ---------------------------------------------------------------------------

def merge_bucketed(batch: DataFrame, path: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """Keep the newest row per key in a bucketed table; only touched buckets are rewritten."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    new = best_row(batch, key, [F.col(c) for c in order]).withColumn("bucket", bucket)
    old = read_state(spark, path, new)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]   # at most `buckets` numbers
    if not touched:
        return
    kept = old.where(F.col("bucket").isin(touched)).select(*new.columns)
    merged = cut(best_row(kept.unionByName(new), [*key, "bucket"], [F.col(c) for c in order]))   # the source folder is rewritten next
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_stream(
    changes: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64
) -> StreamingQuery:
    """Subscribe, update, unsubscribe and prune as one change stream (`deleted` marks removals).

    Removed keys stay as tombstones so that a late older write cannot revive them.
    """
    return start(changes, lambda b, _: merge_bucketed(b, path, key, order, buckets), checkpoint)


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("not deleted").drop("bucket", "deleted")


def prune_changes(outcomes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Deletions for the keys that a push service reported as gone (404 or 410); other outcomes change nothing.

    Add them to the subscriptions that go into `upsert_stream`: one that is made anew after the report lives on.
    """
    return outcomes.where(F.col("status_code").isin(404, 410)).select(*key, *order, F.lit(True).alias("deleted"))


# --- deliveries and the merged feed -----------------------------------------------------------

def ingest_batch(batch: DataFrame, path: str) -> None:
    """Keep each source's latest good delivery and last status; a failed one keeps old matches."""
    spark = batch.sparkSession
    batch = cut(batch)
    status = batch.select("source", "snapshot_at", "ok").distinct()
    merge_bucketed(
        status.groupBy("source").agg(
            F.max("snapshot_at").alias("snapshot_at"), F.max_by("ok", "snapshot_at").alias("ok"),
            F.max(F.when(F.col("ok"), F.col("snapshot_at"))).alias("last_ok_at"),
        ).unionByName(read_last_ok(spark, f"{path}/status"), allowMissingColumns=True).groupBy("source").agg(
            F.max("snapshot_at").alias("snapshot_at"), F.max_by("ok", "snapshot_at").alias("ok"), F.max("last_ok_at").alias("last_ok_at"),
        ), f"{path}/status", ["source"], ["snapshot_at"],
    )
    good = al.last_good_matches(batch)
    if good.isEmpty():
        return
    old = read_state(spark, f"{path}/matches", good)
    newest = good.groupBy("source").agg(F.max("snapshot_at").alias("_at"))
    held = old.groupBy("source").agg(F.max("snapshot_at").alias("_held"))
    fresh = newest.join(held, "source", "left").where("_held is null or _at >= _held").select("source")
    # matches are partitioned by source: a newer good delivery replaces its source's folder
    cut(good.join(fresh, "source", "left_semi")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/matches")


def read_last_ok(spark: SparkSession, path: str) -> DataFrame:
    schema = "source string, snapshot_at timestamp_ntz, ok boolean, last_ok_at timestamp_ntz"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).select("source", "snapshot_at", "ok", "last_ok_at")


def ingest_stream(deliveries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arrivals per source (source string, snapshot_at, ok, id, …) into the latest-good table."""
    return start(deliveries, lambda b, _: ingest_batch(b, path), checkpoint)


def merged_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed as of now: the latest good matches of every source, merged."""
    rows = spark.read.parquet(f"{path}/matches")
    return fd.merge_feeds(rows)


# --- alerts sent once ------------------------------------------------------------------------

def deduplicated_alerts_stream(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each (id, snapshot_at) alert once, however late it comes or whichever producer repeats it.

    What was sent is a table by day and epoch; a batch is compared with the days it touches, in epochs before its own, so an
    epoch that runs again writes the same rows and no alert is too late to be judged.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = cut(batch.select("id", "snapshot_at").distinct().withColumn("day", F.to_date("snapshot_at")).withColumn("epoch", F.lit(epoch).cast("long")))
        days = [r["day"] for r in new.select("day").distinct().collect()]          # as many as there are days in a batch
        old = read_state(spark, path, new).where(F.col("day").isin(days) & (F.col("epoch") < epoch))
        new.join(old, ["id", "snapshot_at"], "left_anti").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(path)

    return start(alerts, fold, checkpoint)


# --- source health and weekly baseline --------------------------------------------------------------

def newest_epoch(spark: SparkSession, path: str) -> str:
    """The newest finished epoch folder of a state table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in found]
    epochs = sorted((int(n.split("=")[1]) for n in names if n.startswith("epoch=")), reverse=True)
    return next(f"{path}/epoch={e}" for e in epochs if exists(spark, f"{path}/epoch={e}/_SUCCESS"))


def current_health(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(newest_epoch(spark, path))


def health_stream(status: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Last status and last success per source, kept current from a stream of status rows.

    One folder per epoch, made from the one before it: a crash while an epoch is written loses nothing.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        new = al.latest_status(batch, ["ordinal"])
        last = batch.groupBy("source").agg(F.max("ordinal").alias("ordinal"))
        new = new.join(last, "source")
        old = read_state(batch.sparkSession, f"{path}/epoch={epoch - 1}", new)
        both = old.unionByName(new).groupBy("source").agg(
            F.max_by(F.struct("ok", "match_count", "error"), "ordinal").alias("s"),
            F.max("last_ok_at").alias("last_ok_at"), F.max("ordinal").alias("ordinal"),
        ).select("source", "s.*", "last_ok_at", "ordinal").select(*new.columns)
        both.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return start(status, fold, checkpoint)


def baseline_stream(lists: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Frozen baseline per ISO week: the last lists published before the week's first ones.

    Keeps, per week, the first and the last lists seen in it; the baseline of a week is the
    last list of the week before.
    """
    def fold(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("week", iso_week(F.col("snapshot_at")))
        new = cut(rows)
        old = read_state(spark, path, new)
        weeks = [r["week"] for r in new.select("week").distinct().collect()]   # a handful of weeks per batch
        both = old.where(F.col("week").isin(weeks)).unionByName(new)
        ends = both.groupBy("week").agg(F.min("snapshot_at").alias("_a"), F.max("snapshot_at").alias("_b"))
        keep = cut(both.join(ends, "week").where("snapshot_at = _a or snapshot_at = _b").drop("_a", "_b").distinct())
        keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)

    return start(lists, fold, checkpoint)


def movement_stream(lists: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Movement of every list against its week's frozen baseline, as lists arrive, late ones included.

    Lists are kept by (week, epoch). A batch changes the weeks it has lists of and, as a late list may be the last of its
    week, the weeks that follow them; only these are worked out again, from their own lists and those of the week before.
    The result is written as a new version of each such week, so an epoch that runs again writes the same.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = lambda df: df.withColumn("epoch", F.lit(epoch).cast("long"))
        new = cut(at(batch.withColumn("week", iso_week(F.col("snapshot_at")))))
        put = lambda df, name: df.write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("week", "epoch").parquet(f"{path}/{name}")
        got = [r["week"] for r in new.select("week").distinct().collect()]         # weeks, not lists: about 52 a year
        if not got:
            return
        put(new, "lists")
        seen = new.select("week", "epoch").distinct()
        put(seen.withColumn("any", F.lit(True)), "weeks")
        known = read_state(spark, f"{path}/weeks", seen).where(F.col("epoch") <= epoch)
        weeks = sorted(r["week"] for r in known.select("week").distinct().collect())
        place = {w: k for k, w in enumerate(weeks)}
        hit = sorted({k for w in got for k in (place[w], place[w] + 1) if k < len(weeks)})
        need = sorted({weeks[k] for h in hit for k in (h - 1, h) if k >= 0})
        rows = read_state(spark, f"{path}/lists", new).where(F.col("week").isin(need) & (F.col("epoch") <= epoch))
        moved = rk.weekly_movement(rows.drop("week", "epoch").distinct())
        put(at(moved.where(F.col("week").isin([weeks[k] for k in hit]))), "movement")

    return start(lists, fold, checkpoint)


def current_movement(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every week."""
    rows = spark.read.parquet(f"{path}/movement")
    last = rows.groupBy("week").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["week", "epoch"], "left_semi").drop("epoch")
