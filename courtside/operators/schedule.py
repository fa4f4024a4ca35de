"""Order of play: start estimates, trailing days, inherited ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import clock_minutes, format_minutes
from courtside.operators.ordered import first_rows, last_known, ordinal_slice, running, sliced


def estimate_starts(rows: DataFrame, width: int = 100_000) -> DataFrame:
    """Estimated start of every upcoming match, chained along its court.

    Input: tournament, day, court, ordinal, court_start, schedule, status, dur (minutes),
    now_min (null unless the day is today). Adds est_min and est_start.

    One match turns the running clock r into max(r + a, b), or into a constant when a live
    match re-anchors the chain. Such steps compose, so after the last re-anchor
        r = S + max(r0, max over earlier steps of (b − S at that step)),  S = sum of a,
    i.e. running sums and maxima instead of a sequential loop. A court is cut into slices of
    ordinals: each slice is reduced to its own step, the steps of the slices are chained, and
    each row starts from the clock at which its slice begins. The rows are shuffled once.
    """
    now = F.col("now_min").cast("double")
    dur = F.nullif(F.col("dur"), F.lit(0)).cast("double")
    step = lk.MATCH_MINUTES + lk.CHANGEOVER_MINUTES
    remaining = F.greatest(F.lit(float(lk.MIN_REMAINING)), lk.MATCH_MINUTES - F.coalesce(dur, F.lit(lk.MATCH_MINUTES / 2)))
    at = clock_minutes(F.col("schedule")).cast("double")
    floor = F.greatest(now, F.when(F.col("schedule").rlike("(?i)not before|starting at"), at))
    final, live = F.col("status") == lk.FINAL, F.col("status") == lk.LIVE
    session = F.coalesce(clock_minutes(F.col("court_start")).cast("double"), at, now, F.lit(float(lk.DEFAULT_SESSION)))
    src = rows.withColumn("court", F.coalesce("court", F.lit("?"))).select(
        "*", floor.alias("_floor"), session.alias("_r0"),
        F.when(live & now.isNotNull(), now + remaining + lk.CHANGEOVER_MINUTES).alias("_anchor"),
        F.when(final, F.coalesce(dur, F.lit(float(lk.MATCH_MINUTES))) + lk.CHANGEOVER_MINUTES)
        .when(live, F.when(now.isNotNull(), 0.0).otherwise(remaining + lk.CHANGEOVER_MINUTES)).otherwise(float(step)).alias("_a"),
        F.when(~final & ~live, floor + step).alias("_b"),
    )
    src = sliced(src, ["tournament", "day", "court"], ordinal_slice(F.col("ordinal"), width))

    # inside a slice: legs between re-anchors, the sum S of each leg and the best b − S so far
    part = Window.partitionBy("_key", "_slice").orderBy("ordinal")
    src = src.withColumn("_leg", F.count("_anchor").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    leg = Window.partitionBy("_key", "_slice", "_leg").orderBy("ordinal")
    src = src.withColumn("_s", F.sum("_a").over(leg.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    src = src.withColumn("_m", F.max(F.col("_b") - F.col("_s")).over(leg.rowsBetween(Window.unboundedPreceding, -1)))
    src = src.withColumn("_from", F.max("_anchor").over(Window.partitionBy("_key", "_slice", "_leg")))

    # one step per slice: a constant exit if it re-anchors, else (a, b)
    end = F.max_by(F.struct("_leg", "_s", "_from", F.greatest("_m", F.col("_b") - F.col("_s")).alias("m")), "ordinal")
    steps = src.groupBy("_key", "_slice").agg(end.alias("e"), F.min_by("_r0", "ordinal").alias("_r0")).select(
        "_key", "_slice", "_r0", F.when(F.col("e._leg") > 0, F.col("e._s") + F.greatest("e._from", "e.m")).alias("k"),
        F.col("e._s").alias("a"), (F.col("e._s") + F.col("e.m")).alias("b"),
    )
    chain = Window.partitionBy("_key").orderBy("_slice")
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(
        "*", F.count("k").over(back(chain)).alias("g"), F.last("k", ignorenulls=True).over(back(chain)).alias("base"),
        F.first("_r0").over(chain).alias("first_r0"),
    )
    run = Window.partitionBy("_key", "g").orderBy("_slice")
    steps = steps.withColumn("sa", F.sum("a").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.max(F.col("b") - F.col("sa")).over(back(run))
    steps = steps.select(
        "_key", "_slice", (F.col("sa") - F.col("a") + F.greatest(F.coalesce("base", "first_r0"), best)).alias("_entry")
    )
    out = src.join(steps, ["_key", "_slice"])
    clock = F.col("_s") - F.col("_a") + F.greatest(F.coalesce("_from", "_entry"), F.col("_m"))   # before this match
    est = F.when(~final & ~live, F.greatest(clock, F.col("_floor")))
    return out.withColumn("est_min", est).withColumn("est_start", format_minutes(F.col("est_min"))).drop(
        "_key", "_slice", "_floor", "_r0", "_anchor", "_a", "_b", "_leg", "_s", "_m", "_from", "_entry"
    )


def est_start_at(est_min: Column, now_min: Column, now: Column) -> Column:
    """Absolute estimate: as many minutes from `now` as the estimate lies past the venue clock."""
    return F.when(now_min.isNotNull(), F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) + (est_min - now_min) * 60))


def trailing_days(days: DataFrame, n: int = 2) -> DataFrame:
    """The last n days with matches, reading days upward and stopping at the first gap after data.

    Input: event_id, day (1, 2, …), matches. Days are distinct numbers per event.
    """
    full = days.where("matches > 0")
    start = full.groupBy("event_id").agg(F.min("day").alias("_start"))
    rows = full.join(start, "event_id")
    # a day belongs to the first unbroken run iff as many days precede it as lie between
    rows = running(rows, ["event_id"], ["day"], ordinal_slice(F.col("day"), 10_000), {"_rank": ("sum", F.lit(1))})
    run = rows.where(F.col("day") - F.col("_start") + 1 == F.col("_rank")).drop("_start", "_rank")
    return first_rows(run, ["event_id"], [F.col("day").desc()], n).drop("rn")


def inherit_rank(rows: DataFrame, width: int = 100_000) -> DataFrame:
    """Season ranking rows where a short (partner) row takes rank and points from above.

    Input: table_id, ordinal, rank, points, is_short. A full row without points stays empty.
    """
    cut = ordinal_slice(F.col("ordinal"), width)
    out = last_known(rows, ["table_id"], ["ordinal"], cut, F.col("rank"), "_rank")
    # points pass down from the row above, through short rows only
    own = F.when(F.col("points").isNotNull() | ~F.col("is_short"), F.struct(F.col("points").alias("p")))
    out = last_known(out, ["table_id"], ["ordinal"], cut, own, "_points")
    return out.withColumn("rank", F.col("_rank")).withColumn("points", F.col("_points.p")).drop("_rank", "_points")


def pair_rows(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows 1-2, 3-4, … of an ordered column as match numbers, with slot 0 / 1."""
    out = running(df, by, [order], ordinal_slice(F.col(order)), {"_n": ("sum", F.lit(1))})
    return out.withColumn("match_no", F.floor((F.col("_n") - 1) / 2)).withColumn("slot", (F.col("_n") - 1) % 2).drop("_n")
