"""Organiser and location lookups with an expiring cache, and resumable backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions import lookups as lk
from courtside.operators.normalise import organiser


def enrich_ttl(df: DataFrame, dim: DataFrame, now: Column, ttl_days: int = lk.MISS_TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """(rows with their organiser, event ids to look up again).

    dim: event_id, organiser (struct, null for a cached miss), looked_up_at. A hit stays
    valid, a miss expires after seven days, a failed lookup was never cached.
    """
    fresh = F.col("organiser").isNotNull() | (
        F.col("looked_up_at") > now - F.make_dt_interval(days=F.lit(ttl_days))
    )
    known = dim.where(fresh).select("event_id", "organiser")
    todo = df.select("event_id").distinct().join(known.select("event_id"), "event_id", "left_anti")
    return df.join(known, "event_id", "left"), todo


def _report(marked: DataFrame) -> DataFrame:
    return marked.groupBy("outcome").agg(F.count("*").alias("n"))


def backfill_locations(t: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tournaments with address and venue, outcome counts). Rows with an address are done.

    info: key, ok (the lookup worked), address, location_name, club_name.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    i = info.select(
        "key", F.col("ok").alias("_ok"), text("address").alias("_address"),
        F.coalesce(text("location_name"), text("club_name")).alias("_venue"),
    )
    done = F.coalesce(F.col("address"), F.lit("")) != ""
    j = t.join(i, "key", "left").withColumn(
        "outcome",
        F.when(done, "skipped").when(~F.coalesce("_ok", F.lit(False)), "failed")
        .when(F.col("_address").isNull() & F.col("_venue").isNull(), "nodata").otherwise("filled"),
    )
    new = F.col("outcome") == "filled"
    out = j.withColumn("address", F.when(new, F.coalesce("_address", "address")).otherwise(F.col("address"))).withColumn(
        "venue", F.when(new, F.coalesce("_venue", "venue")).otherwise(F.col("venue"))
    )
    return out.select(*t.columns, "outcome"), _report(j)


def backfill_organisers(t: DataFrame, info: DataFrame, base: str = "") -> tuple[DataFrame, DataFrame]:
    """(tournaments with their organiser or a no_organizer mark, outcome counts).

    Rows that have either are done; info: key, ok, connected, club_name, club_path.
    """
    i = info.select("key", F.col("ok").alias("_ok"), organiser(F.col("connected"), F.col("club_name"), F.col("club_path"), base).alias("_o"))
    done = (F.coalesce(F.col("organizer_url"), F.lit("")) != "") | F.coalesce(F.col("no_organizer"), F.lit(False))
    j = t.join(i, "key", "left").withColumn(
        "outcome",
        F.when(done, "skipped").when(~F.coalesce("_ok", F.lit(False)), "failed")
        .when(F.col("_o").isNull(), "noclub").otherwise("filled"),
    )
    new = F.col("outcome") == "filled"
    out = (
        j.withColumn("organizer", F.when(new, F.col("_o.name")).otherwise(F.col("organizer")))
        .withColumn("organizer_url", F.when(new, F.col("_o.url")).otherwise(F.col("organizer_url")))
        .withColumn("no_organizer", F.when(F.col("outcome") == "noclub", True).otherwise(F.col("no_organizer")))
    )
    return out.select(*t.columns, "outcome"), _report(j)
