"""Streaming forms over several micro-batches equal the batch forms, also after a replay."""

import pytest
from pyspark.sql import functions as F

from courtside.operators import alerts as al, rankings as rk
from courtside.plans.fixtures import Fixtures
from courtside.streaming import keyed, streams as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF)


def parts(df, path, by):
    """One file per value, in order, so that a stream reads several micro-batches."""
    for v in [r[0] for r in df.select(by).distinct().orderBy(by).collect()]:
        df.where(F.col(by) == v).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def days(spark, rows, schema, path):
    """One file for each list of rows, in order; a row's first value is its day of January, or None for a file without rows."""
    for own in rows:
        df = spark.createDataFrame(own, "day int, " + schema)
        df.withColumn("snapshot_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0))).drop("day").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def told(spark, out, kind):
    return sorted((r["snapshot_at"].day, r["id"]) for r in keyed.results(spark, out, kind).collect() if r["id"])


def test_transitions_of_late_and_empty_snapshots(spark, tmp_path):
    live = lambda day, *ids: [(day, None, None), *[(day, i, "live") for i in ids]]                     # noqa: E731
    files = [
        live(1, 1, 2), live(3, 1, 3), [], live(2, 1),                     # day 2 comes after day 3, within the delay
        live(4), live(8, 1, 2),                                           # nobody is live on day 4; nothing heard of days 5 to 7
        live(4, 9), live(3, 7),                                           # too late: day 8 has passed them
        live(9, 1, 4), live(20),
    ]
    out = str(tmp_path / "out")
    keyed.live_transitions_stream(days(spark, files, "id long, status string", str(tmp_path / "in")), out, str(tmp_path / "ck"), "2 days", 2).awaitTermination()
    assert told(spark, out, keyed.ON_TIME) == [(1, "1"), (1, "2"), (3, "3"), (8, "1"), (8, "2"), (9, "4")]
    assert told(spark, out, keyed.LATE) == [(3, "7"), (4, "9")]
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "waiting").load()
    assert {r["user_map_key"]["at"] for r in state.collect()} == {1705708800000}                                # only the last snapshot waits


def test_transitions_equal_those_of_the_history(spark, fx, tmp_path):
    snaps = keyed.with_deliveries(fx.snapshots.where("snapshot_at < timestamp_ntz'2024-01-06'").select("snapshot_at", "id", "status", "est_start_at"))
    parts(snaps, str(tmp_path / "in"), "snapshot_at")
    snaps.limit(0).unionByName(spark.range(1).select(F.lit("2024-02-01").cast("timestamp_ntz").alias("snapshot_at")), allowMissingColumns=True).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    keyed.soon_transitions_stream(stream(spark, snaps, str(tmp_path / "in")), out, str(tmp_path / "ck"), buckets=2).awaitTermination()
    got = {(r["snapshot_at"], int(r["id"])) for r in keyed.results(spark, out).collect()}
    assert got and got == {(r["snapshot_at"], r["id"]) for r in al.soon_transitions(snaps.where("id IS NOT NULL")).collect()}


def test_score_changes_of_late_rows_and_forgotten_ids(spark, tmp_path):
    files = [
        [(1, 7, 1, "a"), (1, 8, 2, "x"), (1, 7, 3, None)],
        [(3, 7, 6, "b"), (3, 7, 7, "c")], [(2, 7, 4, "b"), (2, 8, 5, "x")],      # out of order: 4 is the change to b, 6 is none
        [(9, 8, 8, "y"), (9, 8, 8, "y")], [],                                     # the same row twice
        [(4, 7, 9, "z")],                                                         # too late
        [(25, 7, 10, "d"), (25, 8, 11, "y")], [(30, 8, 12, "x")], [(31, None, None, None)],
    ]
    out = str(tmp_path / "out")
    keyed.score_changes_stream(days(spark, files, "id long, ordinal long, signature string", str(tmp_path / "in")), out, str(tmp_path / "ck"), "1 day", "18 days", 2).awaitTermination()
    got = sorted((r["ordinal"], r["signature"]) for r in keyed.results(spark, out).collect())
    assert got == [(4, "b"), (7, "c"), (8, "y")]                          # 7 was idle for 22 days: its d is a first sight; day 30 still waits
    assert [(r["ordinal"], r["id"]) for r in keyed.results(spark, out, keyed.LATE).collect()] == [(9, "7")]


def test_alerts_are_sent_once_however_late(spark, tmp_path):
    files = [[(1, 5)], [(9, 5), (9, 6)], [(1, 5), (1, 6), (9, 6)], []]
    sent = str(tmp_path / "sent")
    source = days(spark, files, "id long", str(tmp_path / "in"))
    st.deduplicated_alerts_stream(source, sent, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r["snapshot_at"].day, r["id"], r["epoch"]) for r in spark.read.parquet(sent).collect())
    assert got == [(1, 5, 0), (1, 6, 2), (9, 5, 1), (9, 6, 1)]


def test_upserts_survive_a_replayed_batch(spark, fx, tmp_path):
    rows = fx.table("events").select(F.col("user_id").alias("key"), F.col("ts").alias("updated_at"), "value", (F.col("event_type") == "error").alias("deleted"))
    path = str(tmp_path / "t")
    first, second = rows.where("updated_at < timestamp_ntz'2024-01-15'"), rows.where("updated_at >= timestamp_ntz'2024-01-15'")
    for batch in (first, second, first):                       # the first batch arrives again
        st.merge_bucketed(batch, path, ["key"], ["updated_at"], 4)
    got = {(r["key"], r["updated_at"]) for r in st.current_rows(spark, path).collect()}
    best = rows.groupBy("key").agg(F.max_by(F.struct("updated_at", "deleted"), "updated_at").alias("r"))
    assert got == {(r["key"], r["r"]["updated_at"]) for r in best.collect() if not r["r"]["deleted"]}


def test_failed_delivery_keeps_last_good_matches(spark, tmp_path):
    path = str(tmp_path / "feed")
    row = lambda src, day, ok, ids: spark.createDataFrame(
        [(src, f"2024-01-0{day}", ok, i, 0, n) for n, i in enumerate(ids)], "source string, d string, ok boolean, id string, source_rank int, ordinal int"
    ).select("source", F.col("d").cast("timestamp_ntz").alias("snapshot_at"), "ok", "id", "source_rank", "ordinal")
    st.ingest_batch(row("a", 1, True, ["a1", "a2"]).unionByName(row("b", 1, True, ["b1"])), path)
    st.ingest_batch(row("a", 2, False, ["x"]).unionByName(row("b", 2, True, ["b2"])), path)
    assert {r["id"] for r in st.merged_feed(spark, path).collect()} == {"a1", "a2", "b2"}
    status = {r["source"]: (r["ok"], str(r["last_ok_at"])[:10]) for r in spark.read.parquet(f"{path}/status").collect()}
    assert status == {"a": (False, "2024-01-01"), "b": (True, "2024-01-02")}


def test_movement_of_late_lists(spark, tmp_path):
    """Weeks of 2024-01-01 on; the last list of week 1 comes after those of week 2 and moves them, a week later stays as it is."""
    lists = {1: [("a", 1), ("b", 2)], 16: [("a", 1), ("b", 2)], 9: [("b", 1), ("a", 2), (None, 3)], 6: [("c", 1), ("a", 2), ("b", 3)], 10: [("a", 1)]}
    rows = [[(day, "FIP", "Men", rank, who, f"name {who}", rank) for who, rank in own] for day, own in lists.items()]
    shape = "fed string, category string, rank int, id string, name string, ordinal int"
    src = days(spark, [*rows, []], shape, f"{tmp_path}/in")
    look = lambda df: sorted((r["snapshot_at"].day, r["rank"], str(r["id"]), r["movement"], str(r["delta"]), str(r["movement_state"])) for r in df.collect())
    st.movement_stream(src, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = look(st.current_movement(spark, f"{tmp_path}/out"))
    assert got == look(rk.weekly_movement(spark.read.parquet(f"{tmp_path}/in")))
    assert (9, 1, "b", True, "2", "up") in got and (16, 1, "a", True, "0", "same") in got
    st.movement_stream(src, f"{tmp_path}/out", f"{tmp_path}/ck2").awaitTermination()      # all epochs once more, as after a lost checkpoint
    assert look(st.current_movement(spark, f"{tmp_path}/out")) == got


def test_gone_endpoints_are_pruned(spark, tmp_path):
    shape = "endpoint string, updated_at int, status_code int"
    outcomes = spark.createDataFrame([("gone", 5, 410), ("lost", 5, 404), ("busy", 5, 500), ("back", 5, 410), ("fine", 5, 201)], shape)
    subs = spark.createDataFrame([(k, 1, False) for k in ("gone", "lost", "busy", "back", "fine")] + [("back", 7, False)], "endpoint string, updated_at int, deleted boolean")
    pruned = st.prune_changes(outcomes, ["endpoint"], ["updated_at"])
    for part in (pruned, subs):                                                            # reports first, then older and newer subscriptions
        part.select("endpoint", "updated_at", "deleted").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    st.upsert_stream(stream(spark, subs, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", ["endpoint"], ["updated_at"], 4).awaitTermination()
    assert {r["endpoint"] for r in st.current_rows(spark, f"{tmp_path}/out").collect()} == {"busy", "back", "fine"}
