"""Streaming forms run over the given event table; results equal the batch forms."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from courtside.plans.alerts import LIVE_TRANSITIONS, SCORE_CHANGES, SOON_TRANSITIONS, polls
from courtside.plans.registry import ORACLES, query
from courtside.session import local_folder
from courtside.streaming import keyed, streams as st

day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def work(fx) -> str:
    """A new folder below the shared one the cluster names, else a local one (tests)."""
    shared = fx.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/streams-{uuid.uuid4().hex}"
    return local_folder(fx.spark.sparkContext, "courtside-stream-")


def in_batches(fx, df, name: str, by: list[str], n: int = 4):
    """A derived table over `n` micro-batches; rows are dealt by a hash of `by`, so every batch after the first holds late ones."""
    path = os.path.join(work(fx), name)
    df.repartition(n, *by).write.parquet(path)
    return fx.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events_in_batches(fx):
    return in_batches(fx, fx.table("events"), "events", ["event_id"])


def daily_files(fx, df, name: str, last: str):
    """A stream of one file a day, out of order: each second day comes before the one it follows, some across micro-batches.

    The last file holds a row that only tells the time, so that every day before it becomes final.
    """
    path, df = os.path.join(work(fx), name), df.cache()
    days = [r[0] for r in df.select(F.to_date("snapshot_at")).distinct().orderBy(1).collect()]         # a row a day
    for k in range(1, len(days) - 1, 2):
        days[k], days[k + 1] = days[k + 1], days[k]
    for d in days:
        df.where(F.to_date("snapshot_at") == F.lit(d)).coalesce(1).write.mode("append").parquet(path)
    tick = [F.lit(last).cast(f.dataType).alias(f.name) if f.name == "snapshot_at" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    fx.spark.range(1).select(*tick).write.mode("append").parquet(path)
    df.unpersist()
    return fx.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


@query("stream_live_transitions", LIVE_TRANSITIONS, ("fx_snapshots",))
def stream_live(fx):
    root = work(fx)
    snaps = keyed.with_deliveries(fx.snapshots.select("snapshot_at", "id", "status", "est_start_at"))
    keyed.live_transitions_stream(daily_files(fx, snaps, "snapshots", "2100-01-01"), f"{root}/out", f"{root}/ck", buckets=8).awaitTermination()
    return keyed.results(fx.spark, f"{root}/out").select(day("snapshot_at"), F.col("id").cast("long").alias("id"))


@query("stream_soon_transitions", SOON_TRANSITIONS, ("fx_snapshots",))
def stream_soon(fx):
    root = work(fx)
    snaps = keyed.with_deliveries(fx.snapshots.select("snapshot_at", "id", "status", "est_start_at"))
    keyed.soon_transitions_stream(daily_files(fx, snaps, "snapshots", "2100-01-01"), f"{root}/out", f"{root}/ck", buckets=8).awaitTermination()
    return keyed.results(fx.spark, f"{root}/out").select(day("snapshot_at"), F.col("id").cast("long").alias("id"))


@query("stream_score_changes", SCORE_CHANGES)
def stream_scores(fx):
    root = work(fx)
    rows = polls(fx).withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp_ntz"))
    keyed.score_changes_stream(daily_files(fx, rows, "polls", "2100-01-01"), f"{root}/out", f"{root}/ck", buckets=8).awaitTermination()
    return keyed.results(fx.spark, f"{root}/out").select(F.col("id").cast("long").alias("id"), "ordinal")


@query("stream_upserts", """
SELECT user_id AS key, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")
def stream_upserts(fx):
    root = work(fx)
    changes = events_in_batches(fx).select(
        F.col("user_id").alias("key"), "event_id", F.col("ts").alias("updated_at"), "value", (F.col("event_type") == "error").alias("deleted")
    )
    st.upsert_stream(changes, f"{root}/subs", f"{root}/ck", ["key"], ["updated_at", "event_id"], 8).awaitTermination()
    return st.current_rows(fx.spark, f"{root}/subs").select("key", "value", stamp("updated_at"))


@query("stream_ingest", """
WITH s AS (SELECT DISTINCT 's' || (user_id % 5) AS source, date_trunc('day', ts) AS d FROM events WHERE (day(ts) + user_id % 5) % 3 <> 0),
g AS (SELECT source, max(d) AS d FROM s GROUP BY 1)
SELECT DISTINCT 's' || (user_id % 5) || ':' || user_id AS id FROM events JOIN g ON g.source = 's' || (user_id % 5) AND g.d = date_trunc('day', ts)""")
def stream_ingest(fx):
    root = work(fx)
    d = F.date_trunc("day", "ts").cast("timestamp_ntz")
    # one delivery per source and day; every third one failed
    rows = fx.table("events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), d.alias("snapshot_at"),
        ((F.dayofmonth("ts") + F.col("user_id") % 5) % 3 != 0).alias("ok"),
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"), F.lit(":"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_id").alias("ordinal"), F.lit(0).alias("source_rank"),
    )
    st.ingest_stream(in_batches(fx, rows, "deliveries", ["source", "snapshot_at"]), f"{root}/feed", f"{root}/ck").awaitTermination()
    return st.merged_feed(fx.spark, f"{root}/feed").select("id")


@query("stream_source_health", """
SELECT source, arg_max(ok, ordinal) AS ok, strftime(max(CASE WHEN ok THEN snapshot_at END), '%Y-%m-%d %H:%M:%S') AS last_ok_at FROM fx_source_status GROUP BY 1""", ("fx_source_status",))
def stream_health(fx):
    root = work(fx)
    e = events_in_batches(fx).select(
        (F.col("user_id") % 5).alias("source"), F.col("ts").alias("snapshot_at"), F.col("event_id").alias("ordinal"),
        (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("int").alias("match_count"),
        F.when(F.col("event_type") == "error", "timeout").alias("error"),
    )
    st.health_stream(e, f"{root}/health", f"{root}/ck").awaitTermination()
    return st.current_health(fx.spark, f"{root}/health").select("source", "ok", stamp("last_ok_at"))


@query("stream_baselines", """
WITH w AS (SELECT strftime(snapshot_at, '%G-W%V') AS week, min(snapshot_at) AS a, max(snapshot_at) AS b FROM fx_ranking_rows GROUP BY 1)
SELECT strftime(r.snapshot_at, '%Y-%m-%d') AS snapshot_at, r.fed, r.category, r.rank, r.name FROM fx_ranking_rows r
JOIN w ON strftime(r.snapshot_at, '%G-W%V') = w.week WHERE r.snapshot_at IN (w.a, w.b)""", ("fx_ranking_rows",))
def stream_baselines(fx):
    root = work(fx)
    rows = fx.ranking_rows.select("snapshot_at", "fed", "category", "rank", "id", "name", "ordinal")
    st.baseline_stream(in_batches(fx, rows, "lists", ["snapshot_at"]), f"{root}/base", f"{root}/ck").awaitTermination()
    return fx.spark.read.parquet(f"{root}/base").select(day("snapshot_at"), "fed", "category", F.col("rank").cast("long").alias("rank"), "name")


@query("stream_weekly_movement", ORACLES["weekly_movement"])
def stream_movement(fx):
    """The movement of the whole history, from lists that come in four batches out of order."""
    root = work(fx)
    st.movement_stream(in_batches(fx, fx.ranking_rows, "lists", ["snapshot_at"]), f"{root}/moves", f"{root}/ck").awaitTermination()
    return st.current_movement(fx.spark, f"{root}/moves").select(
        day("snapshot_at"), "fed", "category", F.col("rank").cast("long").alias("rank"), "name", "movement",
        F.col("delta").cast("string").alias("delta"), "movement_state",
    )


@query("stream_pruned_subscriptions", """
SELECT user_id AS key, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE event_type <> 'error' OR event_id % 3 <> 2) WHERE rn = 1 AND event_type <> 'error'""")
def stream_pruned(fx):
    """Subscriptions and what push services answered (404, 410 and 500 in turn), as one stream of changes."""
    root, e, order = work(fx), events_in_batches(fx), ["updated_at", "event_id"]
    e = e.withColumn("key", F.col("user_id")).withColumn("updated_at", F.col("ts"))
    made = e.where("event_type <> 'error'").select("key", *order, "value", F.lit(False).alias("deleted"))
    answers = e.where("event_type = 'error'").withColumn("status_code", F.element_at(F.array(*map(F.lit, (404, 410, 500))), (F.col("event_id") % 3 + 1).cast("int")))
    changes = made.unionByName(st.prune_changes(answers, ["key"], order), allowMissingColumns=True)
    st.upsert_stream(changes, f"{root}/subs", f"{root}/ck", ["key"], order, 8).awaitTermination()
    return st.current_rows(fx.spark, f"{root}/subs").select("key", "value", stamp("updated_at"))


@query("stream_deduplicated_alerts", """
SELECT DISTINCT user_id AS id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events WHERE event_type = 'click'""")
def stream_dedup(fx):
    root = work(fx)
    e = events_in_batches(fx).where("event_type = 'click'").select(
        F.col("user_id").alias("id"), F.date_trunc("hour", "ts").alias("snapshot_at")
    )
    st.deduplicated_alerts_stream(e, f"{root}/sent", f"{root}/ck").awaitTermination()
    return fx.spark.read.parquet(f"{root}/sent").select("id", F.date_format("snapshot_at", "yyyy-MM-dd HH").alias("hour"))
