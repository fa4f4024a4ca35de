"""Record linkage of historic finals, rounds and draws with archive tournaments.

Candidates come from equi-joins on what a pair must share to reach its threshold; the
score is computed per candidate and the best one is kept by aggregation. Equal rows on
either side are scored once.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import day_diff, month_distance
from courtside.functions.labels import draw_round
from courtside.functions.lookups import bind
from courtside.functions.scores import bracket_score, is_bracket_score
from courtside.functions.text import (
    PLACEHOLDER, fold, fused_pair, is_round_report, name_key, overlap, pair_from_lines, pair_label, same_pair, slug,
    tokens,
)
from courtside.operators.contains import contains_pairs, rarest_gram
from courtside.operators.overlap_join import NEAR, overlap_pairs, set_text
from courtside.operators.ordered import best_row, ordinal_slice, running
from courtside.operators.schedule import pair_rows
from courtside.session import cut, rounds, spread
from courtside.sources.tables import GuardFailed


def plain_city(c: Column) -> Column:
    """City without a bracketed remark."""
    return F.trim(F.get(F.split(F.coalesce(c, F.lit("")), r"\("), F.lit(0)))


# --- names against a season schedule --------------------------------------------------

def resolve_schedule(results: DataFrame, schedule: DataFrame) -> DataFrame:
    """Schedule name of each result name of a season: equal slug, else the longest schedule
    slug that contains it or is contained in it (first one on ties), else the name itself.

    Input: results(season, name), schedule(season, name, ordinal).
    """
    r = results.select("season", "name").distinct().withColumn("s", slug(F.col("name")))
    sch = schedule.withColumn("k", slug(F.col("name"))).groupBy("season", "k").agg(
        F.max_by("name", "ordinal").alias("full_name"), F.min("ordinal").alias("ordinal")
    )
    exact = r.join(sch.select("season", F.col("k").alias("s"), "full_name"), ["season", "s"])
    rest = r.join(exact.select("season", "s"), ["season", "s"], "left_anti")
    longer = contains_pairs(
        rest.select("season", F.col("s").alias("needle")), sch.select("season", F.col("k").alias("hay")), ["season"]
    ).select("season", F.col("needle").alias("s"), F.col("hay").alias("k"))
    shorter = contains_pairs(
        sch.select("season", F.col("k").alias("needle")), rest.select("season", F.col("s").alias("hay")), ["season"]
    ).select("season", F.col("hay").alias("s"), F.col("needle").alias("k"))
    near = longer.unionByName(shorter).join(sch, ["season", "k"]).groupBy("season", "s").agg(
        F.max_by("full_name", F.struct(F.length("k"), -F.col("ordinal"))).alias("full_name")
    )
    loose = rest.join(near, ["season", "s"], "left")
    how = F.when(F.col("full_name").isNotNull(), "contained").otherwise("as is")
    return exact.select("season", "name", "full_name", F.lit("equal").alias("how")).unionByName(
        loose.select("season", "name", F.coalesce("full_name", "name").alias("full_name"), how.alias("how"))
    )


# --- season merge ---------------------------------------------------------------------------

def completeness(winners: Column, runners: Column, sets: Column) -> Column:
    """0 to 5: two per full pair, one per partial pair, one for a score."""
    side = lambda c: F.when(F.size(c) == 2, 2).when(F.size(c) > 0, 1).otherwise(0)
    return side(winners) + side(runners) + F.when(F.size(sets) > 0, 1).otherwise(0)


def _facts(rows: DataFrame, key: str) -> DataFrame:
    """First non-empty city, country and start per key in reading order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq"))).alias(c)
    return rows.groupBy(key).agg(
        F.min_by("name", "seq").alias("name"), F.min("season").alias("season"), first("city"), first("country"), first("start")
    )


def merge_seasons(spine: DataFrame, other: DataFrame, days: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tournaments, finals, unmatched) of a season told by two languages.

    Rows: key, season, ordinal, name, city, country, start, finals (map gender → struct of
    winners, runners_up, score, sets). The spine names the events; the other language is
    attached by key, else to the first spine event that starts within `days`, and only
    fills gaps or replaces a less complete final. What matches nothing is reported.
    Rows count in reading order: an event without a start gets one from the first row of
    its key, and rows read after that one, not those before it, can match through it.
    """
    targets = spine.groupBy("key").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("season", "ordinal").alias("season"),
        F.min_by("start", F.when(F.col("start").isNotNull(), F.col("ordinal"))).alias("start"),
    )
    by_key = other.join(targets.select("key"), "key", "left_semi").withColumn("target", F.col("key"))
    rest = other.join(targets.select("key"), "key", "left_anti")
    # a row that matches by date finds a start there, so only rows of the key fill one: one step settles all fills
    fills = by_key.where("start is not null").groupBy("key").agg(
        F.min_by("start", "ordinal").alias("fill"), F.min("ordinal").alias("since")
    )
    always = F.lit(-(1 << 62))
    offers = targets.join(fills, "key", "left").select(
        "season", F.when(F.col("start").isNotNull(), always).otherwise(F.col("since")).alias("time"), F.lit(1).alias("turn"),
        F.struct("ordinal", F.col("key").alias("target")).alias("offer"), F.coalesce("start", "fill").alias("start"),
    ).where("start is not null").withColumn(
        "day", F.explode(F.sequence(F.date_add("start", -days), F.date_add("start", days)))
    ).drop("start")
    asks = rest.select(
        "season", F.col("start").alias("day"), F.col("ordinal").cast("long").alias("time"), F.lit(0).alias("turn"),
        F.struct(*[rest[c] for c in rest.columns]).alias("row"),
    )
    # per day the first event among those offered before a row is read: a running minimum, so no row is multiplied
    placed = running(
        offers.unionByName(asks, allowMissingColumns=True), ["season", "day"], ["time", "turn"],
        ordinal_slice(F.col("time")), {"first": ("min", F.col("offer"))}, inclusive=False,
    ).where("row is not null")
    by_date = placed.where("first is not null").select("row.*", F.col("first.target").alias("target"))
    unmatched = placed.where("first is null").select("row.*")
    attached = by_key.unionByName(by_date.select(*by_key.columns))
    seq = lambda lang: F.struct(F.lit(lang).alias("lang"), F.col("ordinal"))
    rows = spine.withColumn("target", F.col("key")).withColumn("seq", seq(0)).unionByName(attached.withColumn("seq", seq(1)))
    finals = rows.select("target", "seq", F.explode("finals").alias("gender", "f"))
    back = F.struct(-F.col("seq.lang"), -F.col("seq.ordinal"))
    best = finals.groupBy("target", "gender").agg(
        F.max_by(F.struct("f.*", (F.col("seq.lang") == 1).alias("filled")),
                 F.struct(completeness(F.col("f.winners"), F.col("f.runners_up"), F.col("f.sets")), back)).alias("f")
    )
    return (
        _facts(rows, "target").withColumnRenamed("target", "key"),
        best.select(F.col("target").alias("key"), "gender", "f.*"), unmatched,
    )


def longest_table(rows: DataFrame) -> DataFrame:
    """Per season and gender the ranking table with most rows (the earliest on ties)."""
    by = ["year", "gender"]
    n = rows.groupBy(*by, "table_id").agg(F.count("*").alias("n"))
    pick = n.groupBy(*by).agg(F.max_by("table_id", F.struct("n", -F.col("table_id"))).alias("table_id"))
    return rows.join(pick, [*by, "table_id"])


def carry_rounds(new: DataFrame, old_rounds: DataFrame) -> DataFrame:
    """Rounds known before a re-import, for the tournaments it still has."""
    return old_rounds.join(new.select("key").distinct(), "key", "left_semi")


# --- finals against tournaments ---------------------------------------------------------------

def link_finals(rows: DataFrame, t: DataFrame, at_least: float = lk.FINAL_LINK_MIN) -> DataFrame:
    """row_id → tournament key and score.

    rows: row_id, year, city, name, final_date; t: key, ordinal, year, city, name, start.
    City agreement counts 3, word overlap up to 3, a final within ten days of the start up
    to 1.5; below the threshold there is no link and the first tournament wins ties. A link
    therefore needs a common city, a great share of words, or some words and a near date:
    candidates join on these, so few pairs are made that cannot reach the threshold.
    """
    r = rows.withColumn("rc", fold(F.col("city"))).withColumn("rt", tokens(F.col("name"), 3, lk.STOP_FINALS))
    rp = r.select("year", "rc", "rt", F.col("final_date").alias("rd")).distinct()
    tt = t.withColumn("tc", fold(plain_city(F.col("city")))).withColumn("tt", tokens(F.col("name"), 3, lk.STOP_FINALS))
    tp = tt.groupBy("year", "tc", "tt", "start").agg(F.min_by("key", "ordinal").alias("key"), F.min("ordinal").alias("ordinal"))

    near = day_diff(F.col("rd"), F.col("start"))
    date_part = F.when(near <= 10, 1.5 - near / 10).otherwise(0.0)
    has = lambda a, b: F.contains(F.col(a), F.col(b))
    city_part = F.when((F.col("rc") != "") & (F.col("tc") != "") & (has("rc", "tc") | has("tc", "rc")), 3.0).otherwise(0.0)
    prof = ["year", "rc", "rt", "rd"]

    # a common word, as far as it can reach the threshold: names alone need a great share of words, the others a date
    # within ten days or a common city. Names repeat, so word sets are compared once per distinct pair of sets.
    text = lambda c: set_text(c).alias(f"{c}k")
    sets = lambda df, c, *by: df.select("year", *by, F.col(c).alias("words"))
    marks = lambda df: df.withColumnsRenamed({"lk": "rtk", "rk": "ttk"}).withColumn("words", 3 * F.col("share")).drop("share")
    rpk, tpk = rp.select("*", text("rt")), tp.select("*", text("tt"))
    by_name = rpk.join(spread(marks(overlap_pairs(sets(rp, "rt"), sets(tp, "tt"), ["year"], at_least / 3))), ["year", "rtk"]).join(spread(tpk), ["year", "ttk"])
    span = lambda c: F.floor(F.unix_date(c) / 11)
    r_at = rpk.where("rd is not null").withColumn("days", F.explode(F.sequence(span(F.col("rd")) - 1, span(F.col("rd")) + 1)))
    t_at = tpk.where("start is not null").withColumn("days", span(F.col("start")))
    dated = marks(overlap_pairs(sets(r_at, "rt", "days"), sets(t_at, "tt", "days"), ["year", "days"], (at_least - 1.5) / 3))
    by_date = r_at.join(spread(dated), ["year", "days", "rtk"]).join(spread(t_at), ["year", "days", "ttk"]).where(near <= 10)
    rc = rp.select("year", "rc").where("rc <> ''").distinct()
    tc = tp.select("year", "tc").where("tc <> ''").distinct()
    inside = contains_pairs(rc.select("year", F.col("rc").alias("needle")), tc.select("year", F.col("tc").alias("hay")), ["year"])
    around = contains_pairs(tc.select("year", F.col("tc").alias("needle")), rc.select("year", F.col("rc").alias("hay")), ["year"])
    cities = inside.select("year", F.col("needle").alias("rc"), F.col("hay").alias("tc")).unionByName(
        around.select("year", F.col("hay").alias("rc"), F.col("needle").alias("tc"))
    ).distinct()
    t_word = tp.withColumn("w", F.explode("tt"))
    by_city = rp.withColumn("w", F.explode("rt")).join(spread(cities), ["year", "rc"]).join(spread(t_word), ["year", "tc", "w"]).where(
        F.get(F.array_intersect("rt", "tt"), F.lit(0)) == F.col("w")
    ).withColumn("words", 3 * overlap(F.col("rt"), F.col("tt")))
    words = reduce(DataFrame.unionByName, [
        df.withColumn("score", city_part + F.col("words") + F.coalesce(date_part, F.lit(0.0)))
        .where(F.col("score") >= at_least).select(*prof, "key", "ordinal", "score") for df in (by_name, by_date, by_city)
    ])
    # a common city alone: here only the start day matters, so one tournament per city and day will do
    spots = tp.groupBy("year", "tc", "start").agg(F.min_by("key", "ordinal").alias("key"), F.min("ordinal").alias("ordinal"))
    rows_at = rp.select("year", "rc", "rd").distinct()
    city = (
        rows_at.join(spread(cities), ["year", "rc"]).join(spread(spots), ["year", "tc"])
        .withColumn("score", F.lit(3.0) + F.coalesce(date_part, F.lit(0.0)))
        .groupBy("year", "rc", "rd").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "key")).alias("c"))
    )
    best_word = words.groupBy(*prof).agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "key")).alias("w"))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    best = rp.alias("p").join(spread(best_word).alias("b"), same("p", "b", prof), "left").join(
        spread(city).alias("c"), same("p", "c", ["year", "rc", "rd"]), "left"
    ).select(*[F.col(f"p.{c}").alias(c) for c in prof], F.greatest(F.col("b.w"), F.col("c.c")).alias("best"))
    best = best.where(F.col("best.score") >= at_least)
    out = r.withColumn("rd", F.col("final_date")).alias("r").join(spread(best).alias("p"), same("r", "p", prof))
    return out.select("r.row_id", F.col("p.best.key").alias("key"), F.round("p.best.score", 6).alias("score"))


def reconcile(linked: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated finals, outcome per row) of linked final rows.

    linked: row_id, ordinal, key, gender, winners, runners_up, score, winner_ids, runner_ids;
    finals: key, gender, winners, runners_up, score, winner_ids, runner_ids, source.
    Rows are read in order: the first row of a missing final fills it, a fused pair is
    repaired by the first row that explains it, the same pair only lends its ids, anything
    else is a conflict and changes nothing.
    """
    by = ["key", "gender"]
    rows = linked.where(F.size("winners") == 2)
    old = finals.select(
        *by, F.struct("winners", "runners_up", "score", "winner_ids", "runner_ids", "source").alias("old")
    )
    j = rows.join(old, by, "left").withColumn(
        "is_fused", F.coalesce(fused_pair(F.col("old.winners"), F.col("winners")), F.lit(False))
    )
    opens = F.when(F.col("old").isNull() | F.col("is_fused"), F.struct("ordinal", "row_id"))
    row = F.struct("winners", "runners_up", "score", "winner_ids", "runner_ids", "row_id", "ordinal")
    turn = j.groupBy(*by).agg(F.min_by(row, opens).alias("opener"), F.count_if(opens.isNotNull()).alias("_n"))
    turn = turn.select(*by, F.when(F.col("_n") > 0, F.col("opener")).alias("opener"))
    j = j.join(turn, by)
    opener = F.col("opener")
    mine = F.coalesce(opener["row_id"] == F.col("row_id"), F.lit(False))
    later = opener.isNull() | (F.struct("ordinal", "row_id") > F.struct(opener["ordinal"], opener["row_id"]))
    held = F.when(opener.isNotNull() & later, opener["winners"]).otherwise(F.col("old.winners"))
    agrees = same_pair(held, F.col("winners"))
    j = j.withColumn("step", F.when(mine & F.col("old").isNull(), "filled").when(mine, "repaired").when(agrees, "same").otherwise("conflict"))

    keep = lambda ids, prev: F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, ids).otherwise(prev)
    start_w = F.when(F.col("old").isNull(), opener["winner_ids"]).when(opener.isNotNull(), keep(opener["winner_ids"], F.col("old.winner_ids"))).otherwise(F.col("old.winner_ids"))
    start_r = F.when(F.col("old").isNull(), opener["runner_ids"]).when(opener.isNotNull(), keep(opener["runner_ids"], F.col("old.runner_ids"))).otherwise(F.col("old.runner_ids"))
    j = j.withColumn("_w0", start_w).withColumn("_r0", start_r)
    gives = lambda ids, base: (F.col("step") == "same") & (F.coalesce(F.size(base), F.lit(0)) < 1) & (F.coalesce(F.size(ids), F.lit(0)) > 0)
    j = j.withColumn("_gw", gives("winner_ids", "_w0")).withColumn("_gr", gives("runner_ids", "_r0"))
    at = F.struct("ordinal", "row_id")
    first = j.groupBy(*by).agg(
        F.min(F.when(F.col("_gw"), at)).alias("fw"), F.min_by("winner_ids", F.when(F.col("_gw"), at)).alias("ids_w"),
        F.min(F.when(F.col("_gr"), at)).alias("fr"), F.min_by("runner_ids", F.when(F.col("_gr"), at)).alias("ids_r"),
        F.first("old").alias("old"), F.first("opener").alias("opener"), F.first("_w0").alias("_w0"), F.first("_r0").alias("_r0"),
    )
    outcomes = j.join(first.select(*by, "fw", "fr"), by).withColumn(
        "outcome",
        F.when(F.col("step") != "same", F.col("step"))
        .when(F.coalesce(F.col("fw") == at, F.lit(False)) | F.coalesce(F.col("fr") == at, F.lit(False)), "ids added")
        .otherwise("already complete"),
    ).select("row_id", *by, "outcome")

    o, old_ = F.col("opener"), F.col("old")
    new_runners = (
        F.when(old_.isNull(), o["runners_up"])
        .when(o.isNotNull() & (fused_pair(old_["runners_up"], o["runners_up"])
                               | ((F.coalesce(F.size(old_["runners_up"]), F.lit(0)) != 2) & (F.size(o["runners_up"]) == 2))), o["runners_up"])
        .otherwise(old_["runners_up"])
    )
    has = lambda ids: F.coalesce(F.size(ids), F.lit(0)) > 0
    updated = first.select(
        *by, F.coalesce(o["winners"], old_["winners"]).alias("winners"), new_runners.alias("runners_up"),
        F.when(old_.isNull(), o["score"]).otherwise(old_["score"]).alias("score"),
        F.when(has(F.col("_w0")), F.col("_w0")).otherwise(F.col("ids_w")).alias("winner_ids"),
        F.when(has(F.col("_r0")), F.col("_r0")).otherwise(F.col("ids_r")).alias("runner_ids"),
        F.when(old_.isNull(), F.lit("FIP")).otherwise(old_["source"]).alias("source"),
    )
    return updated, outcomes


def outcome_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def missing_finals(t: DataFrame, finals: DataFrame, gender: str = "Women") -> DataFrame:
    """Tournaments that still lack a final of one gender."""
    return t.join(finals.where(F.col("gender") == gender).select("key"), "key", "left_anti")


# --- draws against tournaments -------------------------------------------------------------------

def draw_parts(path: Column) -> Column:
    """struct(month, city) of a draw path; they are its last two segments."""
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    month = lk.lookup(F.try_element_at(seg, F.lit(-2)), lk.MONTHS_ES)
    return F.struct(month.alias("month"), F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit("")).alias("city"))


def _draw_sides(draws: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = draws.withColumn("_p", draw_parts(F.col("path"))).select(
        "path", F.col("ordinal").alias("d_ord"), "year", F.col("_p.month").alias("month"),
        slug(F.col("_p.city"), "").alias("dc"), tokens(F.col("name"), 4, lk.STOP_DRAWS).alias("dt"),
    ).withColumn("dw", F.regexp_replace(F.regexp_replace("dc", "^ppt", ""), r"\d+$", ""))
    known = F.col("start").isNotNull() & (F.date_format("start", "MM-dd") != "01-01")
    tt = t.select(
        "key", F.col("ordinal").alias("t_ord"), "year", slug(plain_city(F.col("city")), "").alias("tc"),
        tokens(F.col("name"), 4, lk.STOP_DRAWS).alias("tt"), slug(F.col("name"), "").alias("tn"),
        F.when(known, F.month("start")).alias("t_month"),
    )
    return d, tt


def _draw_score(words: Column) -> Column:
    has = lambda a, b: F.contains(F.col(a), F.col(b))
    city = F.when((F.col("dc") != "") & (F.col("tc") != ""), F.when(has("tc", "dc") | has("dc", "tc"), 3.0).when(
        F.substring("tc", 1, 5) == F.substring("dc", 1, 5), 2.5).otherwise(0.0)).otherwise(0.0)
    word = F.when((F.length("dw") > 3) & has("tn", "dw"), 3.0).otherwise(0.0)
    d = month_distance(F.col("month"), F.col("t_month"))
    month = F.when(d.isNull(), 0.0).when(d == 0, 3.0).when(d == 1, 1.0).otherwise(-3.0)
    return city + words + word + month


def score_draws(draws: DataFrame, t: DataFrame, at_least: float = lk.DRAW_LINK_MIN) -> DataFrame:
    """Edges path – key with score ≥ 3 among pairs that share a city, a word or a name part.

    draws: path, ordinal, year, name; t: key, ordinal, year, city, name, start. Pairs whose
    only evidence is the month are not listed here, see `month_edges`.
    """
    d, tt = _draw_sides(draws, t)
    dcity, tcity = d.where("dc <> ''"), tt.where("tc <> ''")
    y = ["year"]
    inside = contains_pairs(dcity.select("year", F.col("dc").alias("needle")), tcity.select("year", F.col("tc").alias("hay")), y)
    around = contains_pairs(tcity.select("year", F.col("tc").alias("needle")), dcity.select("year", F.col("dc").alias("hay")), y)
    cities = inside.select("year", F.col("needle").alias("dc"), F.col("hay").alias("tc")).unionByName(
        around.select("year", F.col("hay").alias("dc"), F.col("needle").alias("tc"))
    ).distinct()
    in_city = F.contains("tc", F.col("dc")) | F.contains(F.col("dc"), F.col("tc"))
    near_city = (F.col("dc") != "") & (F.col("tc") != "") & (in_city | (F.substring("tc", 1, 5) == F.substring("dc", 1, 5)))
    # words alone must reach the threshold with at most a month to help them: a great share of words in neighbouring
    # months, any word in the same one; names repeat, so word sets are compared once per distinct pair of sets
    much = (at_least - 1) / 3
    text = lambda c: set_text(c).alias(f"{c}k")
    dk, tk = d.select("*", text("dt")), tt.select("*", text("tt"))
    sets = lambda df, c, *by: df.select("year", *by, F.col(c).alias("words"))
    marks = lambda df: df.withColumnsRenamed({"lk": "dtk", "rk": "ttk"}).withColumn("words", 3 * F.col("share"))
    by_name = marks(overlap_pairs(sets(d, "dt"), sets(tt, "tt"), y, much))
    t_then = tk.where("t_month is not null").withColumn("month", F.col("t_month"))
    by_month = marks(overlap_pairs(sets(d.where("month is not null"), "dt", "month"), sets(t_then, "tt", "month"), ["year", "month"], (at_least - 3) / 3))
    shares_word = F.arrays_overlap("dt", "tt")
    same_month = F.coalesce(F.col("month") == F.col("t_month"), F.lit(False))
    listed = shares_word & (same_month | (overlap(F.col("dt"), F.col("tt")) >= much - NEAR))
    words = contains_pairs(
        d.where("length(dw) > 3").select("year", F.col("dw").alias("needle")), tt.select("year", F.col("tn").alias("hay")), y
    ).select("year", F.col("needle").alias("dw"), F.col("hay").alias("tn"))
    # every pair comes from the first kind of evidence it has, so no pair is listed twice and
    # the score is computed where the pair is found
    found = [
        d.join(spread(cities), ["year", "dc"]).join(spread(tt), ["year", "tc"]),
        dcity.withColumn("p5", F.substring("dc", 1, 5)).join(spread(tcity.withColumn("p5", F.substring("tc", 1, 5))), ["year", "p5"]).where(~in_city),
        dk.join(spread(by_name), ["year", "dtk"]).join(spread(tk), ["year", "ttk"]).where(~near_city),
        dk.join(spread(by_month.where(F.col("share") < much - NEAR)), ["year", "month", "dtk"]).join(spread(t_then), ["year", "month", "ttk"]).where(~near_city),
        d.join(spread(words), ["year", "dw"]).join(spread(tt), ["year", "tn"]).where(~near_city & ~listed),
    ]
    shared = 3 * overlap(F.col("dt"), F.col("tt"))
    score = [_draw_score(shared), _draw_score(shared), _draw_score(F.col("words")), _draw_score(F.col("words")), _draw_score(shared)]
    edges = [
        f.select("path", "key", "d_ord", "t_ord", c.alias("score"), "year").where(F.col("score") >= at_least) for f, c in zip(found, score)
    ]
    return reduce(DataFrame.unionByName, edges)


def month_edges(draws: DataFrame, t: DataFrame, weak: DataFrame) -> DataFrame:
    """Edges of score 3 that rest on the month alone, as few as the assignment can use.

    `draws` and `t` are the still unassigned ends, `weak` the remaining edges of score 3.
    Inside one year and month every free draw fits every free tournament, and the draws
    choose in order: without other edges the i-th draw takes the i-th tournament. Each weak
    edge that touches the month can shift that by one place, so ranks further apart than
    the number of such edges are never chosen and need no edge.
    """
    d, tt = _draw_sides(draws, t)
    block = ["year", "month"]
    d = d.where("month is not null").select(*block, "path", "d_ord")
    tt = tt.where("t_month is not null").select("year", F.col("t_month").alias("month"), "key", "t_ord")
    rank = lambda df, by: running(df, block, [by], ordinal_slice(F.col(by)), {"rk": ("sum", F.lit(1))})
    ends = weak.select("path", "key")
    touch = ends.join(spread(d.select("path", *block)), "path").select(*block).unionByName(
        ends.join(spread(tt.select("key", *block)), "key").select(*block)
    ).groupBy(*block).agg(F.count("*").alias("slack"))
    dr = rank(d, "d_ord").join(spread(touch), block, "left").withColumn("slack", F.coalesce("slack", F.lit(0)))
    # no rank beyond the last tournament of the month
    dr = dr.join(spread(tt.groupBy(*block).agg(F.count("*").alias("last"))), block)
    low, high = F.greatest(F.lit(1), F.col("rk") - F.col("slack")), F.least(F.col("rk") + F.col("slack"), F.col("last"))
    dr = dr.where(low <= high).withColumn("rk", F.explode(F.sequence(low, high)))
    return dr.join(spread(rank(tt, "t_ord")), [*block, "rk"]).select(
        "path", "key", "d_ord", "t_ord", F.lit(3.0).alias("score"), "year"
    )


def assign_one_to_one(edges: DataFrame) -> DataFrame:
    """Greedy best-first assignment, each end used once: path, key, score.

    Order: score descending, then draw, then tournament. Each end points at its best edge; an edge that both of its ends point
    at is certain to be taken. A round looks only at ends whose edge went to another, which point anew among what is left.
    Edges are written once; a round writes the new pointers and the edges taken, and a pointer is written again only when an
    edge of its end died, so all rounds together write no more than the edges. The best edge left is always taken, so it ends.
    """
    spark = edges.sparkSession
    pref = F.struct("score", -F.col("d_ord"), -F.col("t_ord"))
    left = rounds(spark, "edges", edges.select("path", "key", "d_ord", "t_ord", "score"))
    all_edges = left.add(edges.select("path", "key", "d_ord", "t_ord", "score"))
    by_path, by_key = (rounds(spark, n, all_edges.select("path", "key")) for n in ("by-path", "by-key"))
    won = rounds(spark, "won", all_edges)
    at_path = at_key = None                                       # ends that point anew; none yet: all of them
    while True:
        live = all_edges if at_path is None else all_edges.join(won.rows().select("path"), "path", "left_anti").join(won.rows().select("key"), "key", "left_anti")
        of_path = live if at_path is None else live.join(at_path, "path", "left_semi")
        of_key = live if at_key is None else live.join(at_key, "key", "left_semi")
        old_path = by_path.rows()
        new_path = by_path.add(of_path.groupBy("path").agg(F.max_by("key", pref).alias("key")))
        new_key = by_key.add(of_key.groupBy("key").agg(F.max_by("path", pref).alias("path")).select("path", "key"))
        # a pair is taken when its second end points at it: one of the two pointers is new
        both = new_path.join(by_key.rows(), ["path", "key"]).unionByName(old_path.join(new_key, ["path", "key"])).distinct()
        taken = won.add(all_edges.join(both, ["path", "key"]))
        if taken.isEmpty():
            return won.rows().select("path", "key", "score", "d_ord", "t_ord")
        gone = won.rows()
        at_path = by_path.rows().join(taken.select("key"), "key", "left_semi").select("path").distinct().join(gone.select("path"), "path", "left_anti")
        at_key = by_key.rows().join(taken.select("path"), "path", "left_semi").select("key").distinct().join(gone.select("key"), "key", "left_anti")


def _best_first(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges of one season that the greedy assignment takes."""
    e = edges.sort_values(["score", "d_ord", "t_ord"], ascending=[False, True, True], kind="stable")
    paths, keys, taken = set(), set(), []
    for path, key in zip(e["path"], e["key"]):
        taken.append(path not in paths and key not in keys)
        if taken[-1]:
            paths.add(path)
            keys.add(key)
    # a pair listed more than once is taken with all its edges, as the rounds take it
    return e.merge(e.loc[taken, ["path", "key"]], on=["path", "key"])[list(edges.columns)]


def assign_by_season(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """`assign_one_to_one` of edges with a year, whose ends never leave it: path, key, score, d_ord, t_ord.

    A season of at most `most` edges is assigned where it lies, in one pass over its edges; only larger ones go through
    rounds, as an order of draws that all want the same tournament takes one round for each of them.
    """
    cols = ["path", "key", "score", "d_ord", "t_ord"]
    rows = edges.select("year", *cols).where("path is not null and key is not null")
    large = cut(rows.groupBy("year").count().where(F.col("count") > most).select("year"))
    if large.isEmpty():
        return rows.groupBy("year").applyInPandas(_best_first, rows.schema).select(*cols)
    near = rows.join(spread(large), "year", "left_anti").groupBy("year").applyInPandas(_best_first, rows.schema)
    return near.select(*cols).unionByName(assign_one_to_one(rows.join(spread(large), "year", "left_semi").select(*cols)))


def assign_draws(draws: DataFrame, t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path – key pairs, unmatched draws) of a whole season or archive."""
    edges = cut(score_draws(draws, t))
    strong = cut(assign_by_season(edges.where(F.col("score") > lk.DRAW_LINK_MIN)))
    free_d = draws.join(spread(strong.select("path")), "path", "left_anti")
    free_t = t.join(spread(strong.select("key")), "key", "left_anti")
    weak = cut(edges.where(F.col("score") == lk.DRAW_LINK_MIN).join(spread(free_d.select("path")), "path", "left_semi").join(
        spread(free_t.select("key")), "key", "left_semi"
    ))
    rest = assign_by_season(cut(weak.unionByName(month_edges(free_d, free_t, weak)).distinct()))
    pairs = strong.unionByName(rest).select("path", "key", F.round("score", 6).alias("score"))
    return pairs, draws.join(spread(pairs.select("path")), "path", "left_anti")


# --- rounds from draws ----------------------------------------------------------------------------

def classify_cells(cells: DataFrame, header_chars: int | None = lk.HEADER_CHARS) -> DataFrame:
    """Cells below a draw's header with their kind (name / score), round and players.

    The header is the first row that names at least three rounds. A text of more than `header_chars` characters is prose
    that mentions a round and no header; None lets every text be one that the round rule accepts. path, gender, r, c,
    kind, round, label, players, score_text.
    """
    by = ["path", "gender"]
    short = F.lit(True) if header_chars is None else F.length("text") <= header_chars
    text = F.col("text")
    name = F.col("is_name") & ~text.rlike(PLACEHOLDER)
    kind = F.when(name, "name").when(is_bracket_score(text), "score")
    # a text is read once, on its way to its draw; there the draw's few header cells lie beside each cell
    read = F.struct(
        *by, "r", "c", text, F.col("lines"), F.when(short, draw_round(text)).alias("head"), kind.alias("kind")
    )
    cells = cells.where("text <> '' and path is not null and gender is not null").select(
        F.inline(F.filter(F.array(read), lambda s: s["head"].isNotNull() | s["kind"].isNotNull()))
    )
    head = F.when(F.col("head").isNotNull(), F.struct("r", "c", F.col("head").alias("round")))
    marked = cells.withColumn("_heads", F.collect_list(head).over(Window.partitionBy(*by))).where("kind is not null")
    heads, of = F.col("_heads"), lambda rows, f: F.transform(rows, lambda h: h[f])
    named = lambda r: F.size(F.array_compact(F.array_distinct(of(F.filter(heads, lambda h: h["r"].eqNullSafe(r)), "c"))))
    full = F.filter(F.array_distinct(of(heads, "r")), lambda r: named(r) >= 3)
    here = lambda top: of(F.filter(heads, lambda h: (h["r"] == top) & (h["c"] == F.col("c"))), "round")
    no, none = F.array().cast("array<string>"), F.array(F.lit(None).cast("string"))
    rounds = bind(full, lambda rows: F.when(F.size(rows) == 0, no).otherwise(
        bind(here(F.array_min(rows)), lambda at: F.when(F.size(at) == 0, none).otherwise(at))
    ))
    return marked.withColumn("round", F.explode(rounds)).select(
        *by, "r", "c", "kind", "round", pair_label(text).alias("label"), pair_from_lines(F.col("lines")).alias("players"),
        text.alias("score_text"),
    )


def draw_results(classified: DataFrame) -> DataFrame:
    """Matches of a draw: winners, losers and score per round.

    Names pair up down a round's column; the one that appears again in the next round's
    column won. Both or neither: no result. The score is the nearest one to the loser's
    row in either column; without a clean score or two full pairs there is no result.
    """
    by = ["path", "gender"]
    draw = Window.partitionBy(*by)
    is_name, is_score = F.col("kind") == "name", F.col("kind") == "score"
    # the cells of a draw are shuffled once; columns with a round, and the columns that a name is in, lie beside each cell
    cols = F.sort_array(F.collect_set(F.when(F.col("round").isNotNull(), F.struct("c", "round"))).over(draw))
    rows = classified.where("path is not null and gender is not null").select(
        *by, "r", "c", "kind", "score_text", F.when(is_name, F.col("players")).alias("players"),
        F.when(is_name, slug(F.col("label"), "")).alias("k"), cols.alias("_cols"),
    ).withColumn("_in", F.collect_set(F.when(is_name, F.col("c"))).over(Window.partitionBy(*by, "k")))
    step = lambda x, i: F.struct(x["c"].alias("c"), x["round"].alias("round"), F.get(F.col("_cols"), i + 1)["c"].alias("next_c"))
    steps = F.filter(F.transform("_cols", step), lambda s: s["c"] == F.col("c"))
    no_step = F.array(F.struct(F.col("c"), F.lit(None).cast("string").alias("round"), F.lit(None).cast("int").alias("next_c")))
    rows = rows.withColumn("_step", F.explode(F.when(is_name, steps).when(is_score, no_step)))
    adv = F.coalesce(F.col("k").isNotNull() & F.array_contains("_in", F.col("_step.next_c")), F.lit(False))
    side = F.struct("r", "k", "players", adv.alias("adv"), F.col("_step.round").alias("round"), F.col("_step.next_c").alias("next_c"))
    rows = rows.select(*by, "r", "c", "kind", "score_text", side.alias("x"))
    # rows 1-2, 3-4, … of a column; names without a row come first and make no match
    column = Window.partitionBy(*by, "c", "kind").orderBy("r")
    rows = rows.select("*", F.row_number().over(column).alias("_n"), F.lead("x").over(column).alias("y"))
    pair = is_name & (F.col("_n") % 2 == 1) & F.expr(
        "r is not null and x.round = y.round and x.next_c <=> y.next_c and x.k <> y.k and x.adv <> y.adv "
        "and size(x.players) = 2 and size(y.players) = 2"
    )
    scores = F.collect_list(F.when(is_score, F.struct("c", "r", "score_text"))).over(draw)
    won = F.col("x.adv")
    m = rows.where(is_score | pair).withColumn("_scores", scores).where(is_name).select(
        *by, "c", F.col("x.next_c").alias("next_c"), F.col("x.round").alias("round"),
        F.floor((F.col("_n").cast("long") - 1) / 2).alias("match_no"),
        F.when(won, F.col("x")).otherwise(F.col("y")).alias("w"), F.when(won, F.col("y")).otherwise(F.col("x")).alias("l"),
        (F.least("x.r", "y.r") - 1).alias("lo"), (F.greatest("x.r", "y.r") + 2).alias("hi"), "_scores",
    )
    near = F.filter("_scores", lambda s: ((s["c"] == F.col("c")) | (s["c"] == F.col("next_c"))) & s["r"].between(F.col("lo"), F.col("hi")))
    nearest = F.array_min(F.transform(near, lambda s: F.struct(F.abs(s["r"] - F.col("l.r")), s["c"], s["r"], s["score_text"])))
    score = F.array_compact(F.array(bind(nearest["score_text"], bracket_score)))
    return m.select(
        *by, "round", "c", "match_no", F.col("w.players").alias("winners"), F.col("l.players").alias("losers"),
        F.explode(score).alias("score"),
    )


def accuracy_gate(rounds: DataFrame, pairs: DataFrame, finals: DataFrame) -> DataFrame:
    """Verdict per draw with exactly two semifinals: both winners must be the known finalists.

    rounds: path, gender, round, winners; pairs: path, key; finals: key, gender, winners,
    runners_up. Output path, gender, key, hits, verdict.
    """
    by = ["path", "gender"]
    semis = rounds.where("round = 'Semifinal'")
    two = semis.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n = 2").drop("_n")
    f = finals.where("winners is not null").select("key", "gender", F.col("winners").alias("fw"), F.col("runners_up").alias("fr"))
    j = two.join(pairs.select("path", "key"), "path").join(f, ["key", "gender"])
    known = lambda c: F.coalesce((F.size(c) == 2) & same_pair(F.col(c), F.col("winners")), F.lit(False))
    hits = j.groupBy(*by, "key").agg(F.count_if(known("fw") | known("fr")).alias("hits"))
    return hits.withColumn("verdict", F.when(F.col("hits") == 2, "pass").otherwise("fail"))


def gate_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("checked"), F.count_if(F.col("verdict") == "pass").alias("agree"),
        F.coalesce(F.avg((F.col("verdict") == "pass").cast("double")), F.lit(0.0)).alias("rate"),
    )


def require_gate(verdicts: DataFrame, at_least: float = lk.MIN_AGREEMENT) -> None:
    row = gate_rate(verdicts).first()
    if row["rate"] < at_least:
        raise GuardFailed(f"semifinal agreement {row['rate']:.2f} is below {at_least}")


def round_key() -> list[Column]:
    return [
        F.col("key"), F.col("gender"), F.col("round"), name_key(F.col("winners")).alias("wk"), name_key(F.col("losers")).alias("lk")
    ]


def new_rounds(rounds: DataFrame, pairs: DataFrame, verdicts: DataFrame, existing: DataFrame, own: str = "draws") -> DataFrame:
    """Rounds to attach: no finals, no draw that failed the gate, no self-losses, no copies,
    nothing another source already has. Rounds this import wrote before do not count."""
    from courtside.operators.filters import self_loss

    failed = verdicts.where("verdict = 'fail'").select("path", "gender")
    ok = rounds.where("round <> 'Final'").join(pairs.select("path", "key"), "path").join(failed, ["path", "gender"], "left_anti")
    ok = ok.where(~self_loss(F.col("winners"), F.col("losers")))
    keyed = ok.select("*", *round_key()[3:])
    by = ["key", "gender", "round", "wk", "lk"]
    values = [c for c in keyed.columns if c not in by]
    once = keyed.groupBy(*by).agg(F.min_by(F.struct(*values), "ordinal").alias("_r")).select(*by, "_r.*")
    others = existing.where(F.coalesce(F.col("source") != own, F.lit(True))).select(*round_key()).distinct()
    return once.join(others, by, "left_anti").drop("wk", "lk").withColumn("source", F.lit(own))


# --- rounds from articles ------------------------------------------------------------------------------

def best_extraction(rounds: DataFrame) -> DataFrame:
    """One row per extracted match: highest confidence, then most sets, then the first."""
    conf = lk.lookup(F.coalesce("confidence", F.lit("")), lk.CONFIDENCE, 1)
    score = conf * 10 + F.size("sets")
    key = lambda c: name_key(F.col(c), compact=False)
    keyed = rounds.withColumn("wk", key("winners")).withColumn("lk", key("losers")).withColumn("quality", score)
    return best_row(keyed, ["key", "gender", "round", "wk", "lk"], [F.col("quality"), -F.col("ordinal")])


def cross_check(rounds: DataFrame, finals: DataFrame) -> DataFrame:
    """Extracted finals against the authoritative winner: key, gender, agrees."""
    key = lambda c: name_key(F.col(c), compact=False)
    f = finals.select("key", "gender", key("winners").alias("fw"))
    return rounds.where("round = 'Final'").join(f, ["key", "gender"]).select(
        "key", "gender", "winners", (key("winners") == F.col("fw")).alias("agrees")
    )


def discover_articles(t: DataFrame, articles: DataFrame, before: int = 8, after: int = 18) -> DataFrame:
    """Round reports per tournament: published from `before` days ahead of the start to
    `after` days past it, naming the city, a round and a score. key, article_id.

    An index by three letters finds the articles that hold the rarest piece of a city's name; with the day they make the
    candidates, narrow rows. Reports are stored once. A candidate meets its text by article id, where the whole name is searched once.
    """
    active = t.where("start is not null").withColumn("needle", fold(plain_city(F.col("city")))).where("needle <> ''")
    days = active.select(
        "key", "needle", F.explode(F.sequence(F.date_add("start", -before), F.date_add("start", after))).alias("date")
    )
    reports = cut(articles.where(is_round_report(F.col("title"), F.col("text"), F.lit(""))).select(
        "article_id", "date", fold(F.concat_ws(" ", "title", "text")).alias("hay")
    ))                                            # told apart and folded once, read three times
    chosen, index = rarest_gram(days.select("needle"), reports)
    probes = days.select("needle", "date").distinct().join(chosen, "needle")
    candidates = index.join(probes, ["gram", "date"]).select("article_id", "date", "needle")
    hits = candidates.join(reports, ["article_id", "date"]).where(F.contains("hay", F.col("needle"))).select("article_id", "date", "needle")
    return hits.join(days, ["date", "needle"]).select("key", "article_id").distinct()
