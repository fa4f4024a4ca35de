"""Archive views: facets, standings, eras, timeline, brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.functions.dates import when_label
from courtside.functions.labels import circuit, is_knockout, prestige, round_rank
from courtside.functions.text import slug
from courtside.operators.filters import all_axes, archive_axes
from courtside.operators.ordered import first_rows


def facets(index: DataFrame, **choice) -> DataFrame:
    """Counts per year, month and tour, each under all filters but its own: axis, value, n.

    One pass over the index: every row carries one flag per axis and is counted once
    per axis it qualifies for.
    """
    axes = archive_axes(**choice)
    values = {
        "year": F.date_format("start", "yyyy"), "month": F.date_format("start", "MM"),
        "tour": circuit(F.col("tour"), F.col("federation")), "fed": F.col("federation"),
    }
    rows = index.select(
        F.explode(F.array(*[
            F.struct(F.lit(a).alias("axis"), v.alias("value"), all_axes(axes, a).alias("on")) for a, v in values.items()
        ])).alias("f")
    )
    return rows.where("f.on and f.value is not null").groupBy("f.axis", "f.value").agg(F.count("*").alias("n"))


def tour_ranges(index: DataFrame) -> DataFrame:
    """Tournaments and active years per international circuit."""
    rows = index.where("federation = 'FIP'").withColumn("circuit", circuit(F.col("tour"), F.col("federation")))
    return rows.groupBy("circuit").agg(
        F.count("*").alias("n"), F.min(F.year("start")).alias("from_year"), F.max(F.year("start")).alias("to_year")
    )


def prestige_order(index: DataFrame) -> DataFrame:
    """Season view: marquee events first, then the latest."""
    out = index.withColumn("prestige", prestige(F.col("name"), F.col("federation"), F.col("tour")))
    return out.orderBy(F.col("prestige").desc(), F.col("start").desc_nulls_last(), "key")


def date_order(index: DataFrame) -> DataFrame:
    """Newest first; an undated tournament stands at 1 January of its year."""
    out = index.withColumn("start", F.coalesce("start", F.make_date("year", F.lit(1), F.lit(1))))
    return out.orderBy(F.col("start").desc(), "key")


def standings(season_ranking: DataFrame, k: int = 10) -> DataFrame:
    """Top k ranks per season and gender; players sharing a rank are one pair line.

    The ranks are cut to the first k before any names are gathered.
    """
    by = ["year", "gender"]
    top = first_rows(season_ranking.select(*by, "rank").distinct(), by, [F.col("rank")], k, "place")
    rows = season_ranking.join(top, [*by, "rank"])
    names = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"])
    return rows.groupBy(*by, "rank").agg(F.concat_ws(" / ", names).alias("names"), F.min_by("points", "ordinal").alias("points"))


def eras(no1: DataFrame) -> DataFrame:
    """Consecutive years held by the same pair, one row per reign: from, to, years, sources.

    Input: year, gender, pair, authority; one row per year and gender.
    """
    w = Window.partitionBy("gender").orderBy("year")
    same = (F.lag("pair").over(w) == F.col("pair")) & (F.lag("year").over(w) == F.col("year") - 1)
    starts = no1.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    islands = starts.withColumn("_era", F.sum("_new").over(w))
    newest = no1.groupBy("gender").agg(F.max("year").alias("_last"))
    out = islands.groupBy("gender", "_era", "pair").agg(
        F.min("year").alias("from_year"), F.max("year").alias("to_year"),
        F.array_sort(F.collect_set(F.nullif(F.col("authority"), F.lit("")))).alias("sources"),
    )
    return out.join(newest, "gender").select(
        "gender", "pair", "from_year", "to_year", (F.col("to_year") - F.col("from_year") + 1).alias("years"),
        "sources", (F.col("to_year") == F.col("_last")).alias("current"),
    )


def era_filter(e: DataFrame, q: str) -> DataFrame:
    q = q.strip().lower()
    return e.where(F.contains(F.lower("pair"), F.lit(q))) if q else e


def timeline(calendar: DataFrame, live: DataFrame, today: Column, days: int = 3) -> DataFrame:
    """Curated calendar joined with events seen in the feed, by folded name.

    Curated facts win, the live flag is taken over, feed-only events are added; events
    that ended more than `days` ago drop out.
    """
    key = slug(F.col("name"), "")
    facts = ["name", "start", "end", "city", "country", "tour", "category"]
    c = calendar.groupBy(key.alias("k")).agg(F.max_by(F.struct(*facts), "ordinal").alias("c"))
    fill = [F.lit(None).cast("string").alias(x) for x in ("city", "country")]
    l = live.select(key.alias("k"), F.struct("name", "start", "end", *fill, "tour", "category").alias("l"), "live")
    l = l.groupBy("k").agg(F.min("l").alias("l"), F.bool_or("live").alias("live"))
    j = c.join(l, "k", "full_outer").withColumn("e", F.coalesce("c", "l"))
    out = j.select("e.*", F.coalesce("live", F.lit(False)).alias("live_seen"))
    out = out.where(F.coalesce("end", "start") >= F.date_add(today, -days))
    end = F.coalesce("end", "start")
    on = F.col("live_seen") | ((F.col("start") <= today) & (end >= today))
    return out.withColumn("live", on).withColumn(
        "when_label", when_label(F.col("start"), F.col("end"), F.col("live_seen"), today)
    ).drop("live_seen")


# --- knockout brackets -----------------------------------------------------------

def round_index(m: DataFrame) -> DataFrame:
    """Knockout matches with the place of their round (0 is the earliest), per group.

    Rounds follow their rank, then their first appearance; a group with one round has
    no bracket.
    """
    ko = m.where(is_knockout(F.col("round")))
    rounds = ko.groupBy("group", "round").agg(F.min("ordinal").alias("_first")).withColumn("_rank", round_rank(F.col("round")))
    w = Window.partitionBy("group")
    placed = rounds.withColumn("round_ix", F.row_number().over(w.orderBy("_rank", "_first")) - 1).withColumn(
        "rounds", F.count("*").over(w)
    )
    return ko.join(placed.where("rounds >= 2").drop("_first", "_rank"), ["group", "round"])


def bracket_edges(m: DataFrame, project: bool = False) -> DataFrame:
    """Edges of every draw: group, parent_id, child_id, kind, team, round_ix (of the parent).

    A match is fed by the match of the previous round that lists one of its teams (the
    last one when several do); a team without one gets a "bye" edge. With project=True a
    match that feeds nothing gets a "tbd" parent in the next round.
    Input: group, id, round, ordinal, teams (nested).
    """
    ix = round_index(m)
    teams = ix.select(
        "group", "id", "ordinal", "round_ix", "rounds",
        F.explode(F.array_distinct(F.transform("teams", lambda t: F.trim(t["name"])))).alias("team"),
    ).where("team is not null and team <> ''")
    feeders = teams.groupBy("group", (F.col("round_ix") + 1).alias("round_ix"), "team").agg(
        F.max_by("id", "ordinal").alias("child_id")
    )
    fed = teams.where("round_ix > 0").join(feeders, ["group", "round_ix", "team"], "left")
    # one edge per feeding match; a bye keeps the team it stands for
    bye = F.when(F.col("child_id").isNull(), F.col("team"))
    edges = fed.groupBy("group", "round_ix", F.col("id").alias("parent_id"), "child_id", bye.alias("_bye")).agg(
        F.min("team").alias("team")
    ).withColumn("kind", F.when(F.col("child_id").isNull(), "bye").otherwise("match")).drop("_bye")
    if project:
        edges = edges.unionByName(open_slots(ix, edges))
    return edges.select("group", "parent_id", "child_id", "kind", "team", "round_ix")


def open_slots(ix: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs of the next round for matches that feed nothing yet."""
    open_ = ix.where(F.col("round_ix") < F.col("rounds") - 1).join(
        edges.where("kind = 'match'").select("group", F.col("child_id").alias("id")), ["group", "id"], "left_anti"
    )
    none = F.lit(None)
    return open_.select(
        "group", (F.col("round_ix") + 1).alias("round_ix"), none.cast(ix.schema["id"].dataType).alias("parent_id"),
        F.col("id").alias("child_id"), none.cast("string").alias("team"), F.lit("tbd").alias("kind"),
    )


def round_order(rounds: DataFrame, table: dict[str, int]) -> DataFrame:
    """Rounds of a tournament, the final first, by one of the fixed order tables."""
    from courtside.functions.lookups import lookup

    return rounds.withColumn("round_order", lookup(F.col("round"), table, 0))


def append_labels(old: DataFrame, new: DataFrame, key: list[str], label: str) -> DataFrame:
    """Distinct sorted labels per key after adding new ones (seasons done, source notes)."""
    rows = old.select(*key, label).unionByName(new.select(*key, label)).where(F.col(label).isNotNull()).distinct()
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(label)).alias(f"{label}s"))
