"""Ranking lists: movement, races, nationality, points at risk.

ranking rows: snapshot_at, fed, category, rank, id, name, country, points, club, ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import iso_week
from courtside.operators.ordered import first_rows

LIST = ["fed", "category"]


def flatten_ranks(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(list, player) → rank; rows without an id drop out, the last duplicate wins."""
    by = [*(keep or []), *LIST, "id"]
    return rows.where("id is not null").groupBy(*by).agg(F.max_by("rank", "ordinal").alias("rank"))


def page(rows: DataFrame, take: int | None = 250) -> DataFrame:
    """The first rows of every list, as a source delivers them; whole lists if `take` is None."""
    return first_rows(rows, LIST, [F.col("ordinal")], take)


def rank_movement(cur: DataFrame, base: DataFrame) -> DataFrame:
    """Adds movement (the list has a baseline), delta (baseline rank − rank) and its state."""
    tracked = base.select(*LIST).distinct().withColumn("movement", F.lit(True))
    prev = base.select(*LIST, "id", F.col("rank").alias("base_rank"))
    out = cur.join(tracked, LIST, "left").join(prev, [*LIST, "id"], "left")
    return _with_state(out.withColumn("movement", F.coalesce("movement", F.lit(False))))


def _with_state(out: DataFrame) -> DataFrame:
    delta = F.when(F.col("movement") & F.col("id").isNotNull(), F.col("base_rank") - F.col("rank"))
    out = out.withColumn("delta", delta)
    state = (
        F.when(~F.col("movement"), F.lit(None).cast("string"))
        .when(F.col("id").isNull(), "untracked").when(F.col("base_rank").isNull(), "new")
        .when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same")
    )
    return out.withColumn("movement_state", state).drop("base_rank")


def baselines(rows: DataFrame) -> DataFrame:
    """Per snapshot the snapshot its ranks are compared with.

    The first snapshot of an ISO week freezes the last published list of the week before
    as that week's baseline. The very first snapshot seeds the baseline and has nothing
    to compare with. Works on the few distinct snapshots only.
    """
    snaps = rows.select("snapshot_at").distinct().withColumn("week", iso_week(F.col("snapshot_at")))
    weeks = snaps.groupBy("week").agg(F.min("snapshot_at").alias("first_at"), F.max("snapshot_at").alias("last_at"))
    prev = F.lag("last_at").over(Window.orderBy("first_at"))
    weeks = weeks.select("week", F.coalesce(prev, F.col("first_at")).alias("base_at"), prev.isNull().alias("seed_week"))
    return snaps.join(weeks, "week").select(
        "snapshot_at", "week",
        F.when(~(F.col("seed_week") & (F.col("snapshot_at") == F.col("base_at"))), F.col("base_at")).alias("base_at"),
    )


def weekly_movement(rows: DataFrame) -> DataFrame:
    """Movement of every snapshot of a history against its week's frozen baseline."""
    plan = baselines(rows)
    ranks = flatten_ranks(rows, ["snapshot_at"]).withColumnRenamed("snapshot_at", "base_at")
    lists = ranks.select("base_at", *LIST).distinct().withColumn("movement", F.lit(True))
    out = rows.join(plan, "snapshot_at")
    out = out.join(lists, ["base_at", *LIST], "left").join(
        ranks.withColumnRenamed("rank", "base_rank"), ["base_at", *LIST, "id"], "left"
    )
    return _with_state(out.withColumn("movement", F.coalesce("movement", F.lit(False))))


def next_baseline(base: DataFrame | None, published: DataFrame, cur: DataFrame, week: str) -> DataFrame:
    """Baseline to keep for the next run: (week_of, fed, category, id, rank)."""
    stamp = lambda df: flatten_ranks(df).withColumn("week_of", F.lit(week))
    if base is None or base.isEmpty():
        return stamp(cur)
    if not base.where(F.col("week_of") == week).isEmpty():
        return base
    return stamp(published)


def player_ranks(rows: DataFrame) -> DataFrame:
    """Every list a player is in, its first row per list; place 1 is the best rank."""
    values = [c for c in rows.columns if c not in (*LIST, "id")]
    one = rows.where("id is not null").groupBy("id", *LIST).agg(F.min_by(F.struct(*values), "ordinal").alias("r"))
    out = one.select("id", *LIST, "r.*")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank", *LIST)))


def race(rows: DataFrame, k: int = 5) -> DataFrame:
    """First k rows per list with the gap to the leader; needs two rows and a first `defending`."""
    top = first_rows(rows, LIST, [F.col("ordinal")], k, "place")
    lead = top.groupBy(*LIST).agg(
        F.max(F.when(F.col("place") == 1, F.col("points"))).alias("leader"),
        F.max(F.when(F.col("place") == 1, F.col("defending").isNotNull())).alias("_ok"), F.count("*").alias("_n"),
    ).where("_n >= 2 and _ok")
    return top.join(lead.drop("_n", "_ok"), LIST).withColumn("gap", F.col("leader") - F.col("points")).drop("leader")


def nationalities(rows: DataFrame) -> DataFrame:
    """Rows per country and list, for lists with more than one country."""
    counts = rows.where("country is not null and country <> ''").groupBy(*LIST, "country").agg(F.count("*").alias("n"))
    many = counts.groupBy(*LIST).agg(F.count("*").alias("_c")).where("_c > 1")
    return counts.join(many.select(*LIST), LIST, "left_semi")


def points_at_risk(awards: DataFrame, now: Column, days: int = lk.AT_RISK_DAYS) -> DataFrame:
    """Points per player and list that run out within `days`; an award lives 52 weeks."""
    ends = F.date_add("award_date", lk.POINTS_LIFE_DAYS)
    due = (ends >= now) & (ends <= F.date_add(now, days))
    live = ends >= now
    return awards.groupBy(*LIST, "id").agg(
        F.sum(F.when(live, F.col("points")).otherwise(0)).alias("points"),
        F.sum(F.when(due, F.col("points")).otherwise(0)).alias("defending"),
    )


def list_rows(rows: DataFrame, k: int | None = 250) -> DataFrame:
    """Shown part of every list in list order; whole lists if k is None."""
    return first_rows(rows, LIST, [F.col("ordinal")], k)
