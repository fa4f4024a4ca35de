"""The merged feed and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import day_heading, match_date
from courtside.functions.labels import (
    competition_format, event_category, is_knockout, region_label, round_rank, split_category, start_minute,
    status_order, tier,
)
from courtside.operators.filters import feed_filter
from courtside.operators.ordered import best_row, first_rows


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Ordered concatenation: each feed keeps its own ordinal under its rank."""
    out = None
    for rank, feed in enumerate(feeds):
        part = feed.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_feeds(m: DataFrame) -> DataFrame:
    """One row per id: the last write decides the value, the first one the place.

    Needs source_rank and ordinal. Copies of one id are cut to the last one on every task before
    the shuffle; first places are aggregated apart, as (id, place) only, and meet the rows by id.
    """
    values = [c for c in m.columns if c not in ("id", "source_rank", "ordinal")]
    keyed = m.withColumn("_key", F.struct("id"))          # a struct, so that null ids are one id, as in a grouping
    last = best_row(keyed, ["_key"], [F.col("source_rank"), F.col("ordinal")])
    first = keyed.groupBy("_key").agg(F.min(F.struct("source_rank", "ordinal")).alias("first_seen"))
    return last.select("_key", "id", *values).join(first, "_key").select("id", *values, "first_seen")


def feed_order() -> list[Column]:
    return [status_order(F.col("status")), F.coalesce("start_time", F.lit("")), F.col("first_seen")]


def best_variant(rows: DataFrame) -> DataFrame:
    """One row per (event, header, players): most sets up to three; more than three is worst."""
    n = F.size("sets")
    rank = F.when(n <= 3, n).otherwise(-n)
    key = F.to_json(F.struct("header", "players_a", "players_b"))
    best = best_row(rows.withColumn("_key", key), ["event_id", "_key"], [rank, -F.col("ordinal")])
    return best.select("event_id", *[c for c in rows.columns if c != "event_id"])


def distinct_first(df: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """First row per key in feed order."""
    first = first_rows(df, key, [F.col(ordinal).asc_nulls_last()], 1, "_place")
    return first.select(*key, *[c for c in df.columns if c not in key])


def tally(m: DataFrame, key: str) -> DataFrame:
    return m.groupBy(key).agg(F.count("*").alias("n"))


def tally_both(m: DataFrame) -> DataFrame:
    """Counts by status and by federation in one pass."""
    sets = m.groupingSets([["status"], ["federation"]], "status", "federation")
    axis = F.when(F.grouping("federation") == 1, "status").otherwise("federation")
    return sets.agg(F.count("*").alias("n"), axis.alias("axis")).select(
        "axis", F.coalesce("status", "federation").alias("value"), "n"
    )


def source_status(deliveries: DataFrame) -> DataFrame:
    """Per source of a refresh: contributed matches, ok, error text."""
    return deliveries.groupBy("source").agg(
        F.count("id").alias("count"), F.bool_and("ok").alias("ok"),
        F.max(F.when(~F.col("ok"), F.col("error"))).alias("error"),
    )


# --- tournaments of the feed ---------------------------------------------------

def tournament_key() -> Column:
    return F.concat_ws(":", "source", "tournament.id")


def team_players(teams: Column) -> Column:
    """Names in the team labels, split at "/"."""
    parts = F.flatten(F.transform(teams, lambda t: F.split(F.coalesce(t["name"], F.lit("")), "/")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def player_counts(m: DataFrame, key: list[str]) -> DataFrame:
    names = m.select(*key, F.explode(team_players(F.col("teams"))).alias("player"))
    return names.groupBy(*key, "player").agg(F.lit(1).alias("x")).groupBy(*key).agg(F.count("*").alias("players"))


def competitions(m: DataFrame) -> DataFrame:
    """Competitions of the feed with size, players, live and upcoming counts, format and order."""
    src = m.withColumn("key", tournament_key())
    base = src.groupBy("key").agg(
        F.min_by("tournament.name", "ordinal").alias("name"), F.min_by("source", "ordinal").alias("source"),
        F.min_by("federation", "ordinal").alias("federation"), F.count("*").alias("matches"),
        F.count_if(F.col("status") == lk.LIVE).alias("live"),
        F.count_if(F.col("status") == lk.UPCOMING).alias("upcoming"),
        F.bool_or(is_knockout(F.col("round"))).alias("_ko"),
    )
    out = base.join(player_counts(src, ["key"]), "key", "left").withColumn("players", F.coalesce("players", F.lit(0)))
    return out.withColumn("format", competition_format(F.col("_ko"), F.col("name"))).withColumn(
        "tier", tier(F.col("name"))
    ).drop("_ko")


def competition_order() -> list[Column]:
    return [
        (F.col("live") > 0).desc(), F.col("tier").desc(), F.col("matches").desc(), F.col("name"), F.col("key"),
    ]


def filter_competitions(c: DataFrame, fed: str = "all", q: str = "") -> DataFrame:
    out = c if fed == "all" else c.where(F.col("federation") == fed)
    return out.where(F.contains(F.lower("name"), F.lit(q.strip().lower()))) if q.strip() else out


def tournament_header(m: DataFrame) -> DataFrame:
    """Matches, distinct players, date span and live count per tournament."""
    src = m.withColumn("key", tournament_key()).withColumn("d", F.substring("start_time", 1, 10))
    out = src.groupBy("key").agg(
        F.count("*").alias("matches"), F.min("d").alias("first_day"), F.max("d").alias("last_day"),
        F.count_if(F.col("status") == lk.LIVE).alias("live"),
    )
    return out.join(player_counts(src, ["key"]), "key", "left")


def live_spans(m: DataFrame, today: Column, source: str = "fip") -> DataFrame:
    """First and last day, live flag and category per tournament name of one source."""
    d = match_date(F.col("start_time"), F.col("day.label"), today)
    rows = m.where(F.col("source") == source).select(F.col("tournament.name").alias("name"), d.alias("d"), "status")
    out = rows.where("name is not null and name <> '' and d is not null").groupBy("name").agg(
        F.min("d").alias("start"), F.max("d").alias("end"), F.bool_or(F.col("status") == lk.LIVE).alias("live")
    )
    return out.withColumn("tour", F.lit("FIP")).withColumn("category", event_category(F.col("name")))


def day_strip(m: DataFrame, today: Column, status: str = "all", fed: str = "all", q: str = "") -> DataFrame:
    """Matches per calendar day under all filters but the day; no gap, today always in.

    The span reaches from the first to the last day with matches, but no further than
    nine days back and twenty-one ahead.
    """
    d = match_date(F.col("start_time"), F.col("day.label"), today)
    counts = m.where(feed_filter(status, fed, q)).select(d.alias("day")).where("day is not null").groupBy("day").agg(
        F.count("*").alias("n")
    )
    lo, hi = F.date_add(today, -lk.LOOKBACK_DAYS), F.date_add(today, lk.LOOKAHEAD_DAYS)
    span = counts.where(F.col("day").between(lo, hi)).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(
        F.explode(F.sequence(F.least(F.coalesce("lo", today), today), F.greatest(F.coalesce("hi", today), today))).alias("day")
    )
    return days.join(counts, "day", "left").select(
        "day", F.date_format("day", "EEE").alias("weekday"), F.date_format("day", "dd.MM").alias("label"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.col("day") == today).alias("is_today"),
    )


def group_layout(m: DataFrame) -> DataFrame:
    """Tournament groups inside federation sections: international first, then by region name;
    inside a section by tier and size."""
    src = m.withColumn("key", tournament_key())
    g = src.groupBy("key").agg(
        F.min_by("tournament.name", "ordinal").alias("name"), F.min_by("federation", "ordinal").alias("federation"),
        F.count("*").alias("matches"), F.min("ordinal").alias("first_seen"),
        F.count_if(F.col("status") == lk.LIVE).alias("live"),
    )
    sections = g.groupBy("federation").agg(F.count("*").alias("events"), F.sum("matches").alias("section_matches"))
    label = region_label(F.col("federation"))
    return g.join(sections, "federation").select(
        "federation", label.alias("section"), "events", "section_matches", "key", "name", "matches", "live", "first_seen",
        F.when(F.col("federation") == "FIP", "").otherwise(label).alias("section_order"),
        (tier(F.col("name")) * 1000 + F.col("matches")).alias("rank"),
    )


def group_order() -> list[Column]:
    return [F.col("section_order"), F.col("federation"), F.col("rank").desc(), F.col("first_seen")]


def match_order() -> list[Column]:
    """Order inside a group: live, upcoming by start minute (unknown last), finished."""
    minute = F.when(
        F.col("status") == lk.UPCOMING, start_minute(F.col("est_start"), F.col("start_time"), F.col("schedule"))
    ).otherwise(F.lit(0.0))
    return [status_order(F.col("status")), minute.asc_nulls_last(), F.col("ordinal")]


def group_matches(m: DataFrame, k: int | None = 20) -> DataFrame:
    """The first k matches of every tournament group in display order, all of them if k is None."""
    return first_rows(m.withColumn("key", tournament_key()), ["key"], match_order(), k)


def draw_layout(m: DataFrame) -> DataFrame:
    """Class, round and round rank per match for a draw page (rounds by rank descending)."""
    s = split_category(F.col("class_name"), F.col("round"))
    out = m.withColumn("key", tournament_key()).withColumn("_s", s)
    return out.withColumn("cls", F.col("_s.cls")).withColumn("round_name", F.col("_s.round")).withColumn(
        "rank", round_rank(F.col("_s.round"))
    ).drop("_s")


def draw_groups(m: DataFrame) -> DataFrame:
    """Matches per tournament, class and round with the class's place of first appearance."""
    d = draw_layout(m)
    rounds = d.groupBy("key", "cls", "round_name", "rank").agg(
        F.count("*").alias("matches"), F.min("ordinal").alias("first_seen")
    )
    classes = d.groupBy("key", "cls").agg(F.min("ordinal").alias("class_seen"))
    return rounds.join(classes, ["key", "cls"])


def by_day(m: DataFrame) -> DataFrame:
    """Schedule of a tournament: play-day number, else calendar day, else to be confirmed (last)."""
    dated = F.col("start_time").rlike(r"^\d{4}-\d{2}-\d{2}")
    day = F.when(dated, F.substring("start_time", 1, 10).try_cast("date"))
    n = F.col("day.n")
    out = m.withColumn("key", tournament_key())
    return out.withColumn(
        "day_key", F.when(n.isNotNull(), F.concat(F.lit("d"), n.cast("string"))).when(day.isNotNull(), day.cast("string")).otherwise("tbc")
    ).withColumn(
        "day_sort", F.struct(
            F.when(n.isNotNull(), 0).when(day.isNotNull(), 1).otherwise(2).alias("kind"), n.alias("n"), day.alias("d")
        )
    ).withColumn(
        "day_label", F.when(n.isNotNull(), F.col("day.label")).otherwise(day_heading(day))
    )


def day_groups(m: DataFrame) -> DataFrame:
    """One row per tournament and play day with its heading."""
    from pyspark.sql import Window

    g = by_day(m).groupBy("key", "day_key").agg(
        F.count("*").alias("matches"), F.min("day_sort").alias("day_sort"), F.min_by("day_label", "ordinal").alias("day_label")
    )
    place = F.row_number().over(Window.partitionBy("key").orderBy("day_sort"))
    number = F.coalesce(F.col("day_sort.n"), place)
    head = F.when(F.col("day_key") == "tbc", "Date TBC").otherwise(
        F.concat(F.lit("Day "), number.cast("string"), F.coalesce(F.concat(F.lit(" · "), F.col("day_label")), F.lit("")))
    )
    return g.select("key", "day_key", head.alias("heading"), "matches")


def find_tournament(keys: DataFrame, archive: DataFrame, m: DataFrame) -> DataFrame:
    """Facts of a tournament (source, id): the archive's, else the first live match's."""
    a = archive.select(
        F.col("key").alias("arch_key"), F.struct("name", "federation", "start", "end", "venue", "address", "organizer", "organizer_url").alias("a")
    )
    live = m.groupBy("source", F.col("tournament.id").alias("id")).agg(
        F.min_by(
            F.struct(
                F.col("tournament.name").alias("name"), "federation", "tournament.start", "tournament.end",
                "tournament.venue", "tournament.address", "tournament.organizer", "tournament.organizer_url",
            ),
            "ordinal",
        ).alias("l")
    )
    j = keys.withColumn("arch_key", F.concat_ws("-", "source", "id")).join(a, "arch_key", "left").join(
        live, ["source", "id"], "left"
    )
    pick = F.when(F.col("a.name").isNotNull(), F.col("a")).otherwise(F.col("l"))
    origin = F.when(F.col("a.name").isNotNull(), "archive").when(F.col("l.name").isNotNull(), "live").otherwise("none")
    return j.withColumn("_p", pick).select("source", "id", origin.alias("origin"), "_p.*")
