"""Archive lists, facets, brackets, timeline and schedule estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions import lookups as lk
from courtside.functions.labels import split_category
from courtside.operators import archive as ar, filters as fl, normalise as nm, schedule as sch
from courtside.operators.ordered import best_row
from courtside.plans.fixtures import TODAY, pick, today
from courtside.plans.registry import cte, query
from courtside.sources.archive import archive_index

IDX = ("fx_archive_index",)
d = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


@query("archive_index", """
SELECT key, name, federation, tour, coalesce(tour, CASE WHEN federation = 'FIP' THEN 'FIP' END) AS circuit, strftime(start, '%Y-%m-%d') AS start, n FROM fx_archive_index
UNION ALL SELECT 'wpt-' || ordinal, name, 'FIP', coalesce(tour, 'WPT'), coalesce(tour, 'WPT'), strftime(start, '%Y-%m-%d'), n FROM fx_archive_index""", IDX)
def archive_index_(fx):
    old = fx.archive_index.withColumn("key", F.concat(F.lit("wpt-"), F.col("ordinal").cast("string")))
    return archive_index(fx.archive_index, old).select("key", "name", "federation", "tour", "circuit", d("start"), "n")


@query("archive_filter", """
SELECT key FROM fx_archive_index WHERE federation = 'FIP' AND tour = 'WPT' AND year(start) = 1995 AND month(start) = 2""", IDX)
def archive_filter(fx):
    return fl.filter_archive(fx.archive_index, fed="FIP", tour="WPT", year="1995", month="02").select("key")


@query("archive_filter_skip", """
SELECT key FROM fx_archive_index WHERE federation = 'FIP' AND month(start) = 2 AND contains(lower(name), 'p1')""", IDX)
def archive_filter_skip(fx):
    return fl.filter_archive(fx.archive_index, skip="year", fed="FIP", year="1995", month="02", q="P1").select("key")


_C = "coalesce(tour, CASE WHEN federation = 'FIP' THEN 'FIP' END)"


@query("facet_counts", f"""
SELECT 'year' AS axis, strftime(start, '%Y') AS value, count(*) AS n FROM fx_archive_index WHERE federation = 'FIP' AND {_C} = 'WPT' AND month(start) = 1 GROUP BY 2
UNION ALL SELECT 'month', strftime(start, '%m'), count(*) FROM fx_archive_index WHERE federation = 'FIP' AND {_C} = 'WPT' AND year(start) = 1995 GROUP BY 2
UNION ALL SELECT 'tour', {_C}, count(*) FROM fx_archive_index WHERE federation = 'FIP' AND year(start) = 1995 AND month(start) = 1 GROUP BY 2
UNION ALL SELECT 'fed', federation, count(*) FROM fx_archive_index WHERE {_C} = 'WPT' AND year(start) = 1995 AND month(start) = 1 GROUP BY 2""", IDX)
def facet_counts(fx):
    return ar.facets(fx.archive_index, fed="FIP", tour="WPT", year="1995", month="01")


@query("tour_ranges", f"""
SELECT {_C} AS circuit, count(*) AS n, CAST(min(year(start)) AS INT) AS from_year, CAST(max(year(start)) AS INT) AS to_year FROM fx_archive_index WHERE federation = 'FIP' GROUP BY 1""", IDX)
def tour_ranges(fx):
    return ar.tour_ranges(fx.archive_index)


_PRESTIGE = """CASE WHEN federation = 'FIP' THEN 1000 ELSE 0 END + CASE word WHEN 'Major' THEN 92 WHEN 'P1' THEN 88 WHEN 'P2' THEN 80 WHEN 'Gold' THEN 70
  WHEN 'Open' THEN CASE WHEN tour = 'WPT' THEN 66 ELSE 42 END WHEN 'Silver' THEN 52 WHEN 'Bronze' THEN 34 ELSE 25 END"""


@query("prestige_order", f"""
SELECT key, {_PRESTIGE} AS prestige FROM fx_archive_index ORDER BY prestige DESC, start DESC NULLS LAST, key""", IDX)
def prestige_order(fx):
    return ar.prestige_order(fx.archive_index).select("key", "prestige")


@query("archive_date_order", """
SELECT key, strftime(coalesce(start, make_date(year, 1, 1)), '%Y-%m-%d') AS start FROM fx_archive_names ORDER BY coalesce(start, make_date(year, 1, 1)) DESC, key""", ("fx_archive_names",))
def archive_date_order(fx):
    return ar.date_order(fx.archive_names).select("key", d("start"))


@query("recent_or_future_events", f"""
SELECT key FROM fx_archive_index WHERE coalesce("end", start) >= DATE '{TODAY}' - 3""", IDX)
def recent_or_future(fx):
    return fl.recent_or_future(fx.archive_index, today()).select("key")


@query("covers_day", f"""
SELECT key FROM fx_archive_index WHERE start <= DATE '{TODAY}' AND "end" >= DATE '{TODAY}'""", IDX)
def covers_day(fx):
    return fl.covers_day(fx.archive_index, today()).select("key")


@query("overlaps_window", f"""
SELECT key FROM fx_archive_index WHERE start <= DATE '{TODAY}' + 7 AND CASE WHEN ordinal % 5 = 0 THEN start ELSE "end" END >= DATE '{TODAY}' - 4""", IDX)
def overlaps_window(fx):
    ix = fx.archive_index.withColumn("end", F.when(F.col("ordinal") % 5 != 0, F.col("end")))
    return fl.overlaps_window(ix, F.date_add(today(), -4), F.date_add(today(), 7)).select("key")


_CC = "['dk','ES','se','AR','fr'][ordinal % 5 + 1]"


@query("calendar_discovery", f"""
SELECT key, upper({_CC}) AS country FROM fx_archive_index WHERE start <= DATE '{TODAY}' + 3 AND "end" >= DATE '{TODAY}' - 3
  AND upper({_CC}) NOT IN ('DK','SE','DE','CZ')""", IDX)
def calendar_discovery(fx):
    ev = fx.archive_index.withColumn("event_id", F.col("key")).withColumn("country", pick(F.col("ordinal") % 5, "dk", "ES", "se", "AR", "fr"))
    return fl.calendar_events(ev, today()).select("key", "country")


@query("recently_modified", f"""
SELECT slug, yr AS year FROM (SELECT name || CASE WHEN ordinal % 3 = 0 THEN '-promises' ELSE '' END || CASE WHEN ordinal % 2 = 0 THEN '-2019' ELSE '' END AS slug,
  CASE WHEN ordinal % 2 = 0 THEN '2019' ELSE '1998' END AS yr, "end", ordinal FROM fx_archive_index) WHERE "end" >= DATE '{TODAY}' - 2 AND ordinal % 3 <> 0""", IDX)
def recently_modified(fx):
    o = F.col("ordinal")
    ev = fx.archive_index.select(
        F.concat("name", F.when(o % 3 == 0, "-promises").otherwise(""), F.when(o % 2 == 0, "-2019").otherwise("")).alias("slug"), F.col("end").alias("modified")
    )
    return fl.recently_modified(ev, today()).select("slug", "year")


@query("play_days", f"""
SELECT event_id, strftime(x, '%Y-%m-%d') AS play_day, rn FROM (
  SELECT event_id, x, row_number() OVER (PARTITION BY event_id ORDER BY x) AS rn FROM (
    SELECT DISTINCT o_custkey % 20 AS event_id, CAST(o_orderdate AS DATE) AS x FROM orders WHERE o_orderkey % 9 <> 0) WHERE x BETWEEN DATE '{TODAY}' - 4 AND DATE '{TODAY}' + 7)""")
def play_days(fx):
    k = F.col("o_orderkey")
    rows = fx.table("orders").select(
        (F.col("o_custkey") % 20).alias("event_id"), F.when(k % 9 == 0, "2020-1").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("code")
    )
    return fl.play_days(rows, today()).select("event_id", d("play_day"), F.col("rn").cast("long").alias("rn"))


@query("trailing_days", """
WITH days AS (SELECT user_id AS event_id, day(ts) AS day, count(*) FILTER (event_type = 'click') AS matches FROM events GROUP BY 1, 2),
full_days AS (SELECT event_id, day, day - row_number() OVER (PARTITION BY event_id ORDER BY day) AS island FROM days WHERE matches > 0)
SELECT event_id, CAST(day AS INT) AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY day DESC) AS rn FROM full_days f
  WHERE island = (SELECT min(island) FROM full_days g WHERE g.event_id = f.event_id)) WHERE rn <= 2""")
def trailing_days(fx):
    rows = fx.table("events").groupBy(F.col("user_id").alias("event_id"), F.dayofmonth("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "click").alias("matches")
    )
    return sch.trailing_days(rows).select("event_id", "day")


# --- court chain -----------------------------------------------------------------------------------
cte("fx_courts", """
SELECT o_custkey % 97 AS tournament, o_custkey % 3 AS day, 'Court ' || (o_orderkey % 2) AS court, o_orderkey AS ordinal,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 540 + (o_custkey % 97) END AS court_start,
  ['Not before 3:00 PM','Followed by','Starting at 10:00 AM',NULL][o_orderkey % 4 + 1] AS schedule, [900, NULL, 600, NULL][o_orderkey % 4 + 1] AS phrase,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN [900, NULL, 600, NULL][o_orderkey % 4 + 1] END AS explicit_at,
  CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'live' ELSE 'upcoming' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 40 + o_orderkey % 60 END AS dur,
  CASE WHEN o_custkey % 3 = 0 THEN 600 + o_custkey % 97 END AS now_min,
  row_number() OVER (PARTITION BY o_custkey % 97, o_custkey % 3, o_orderkey % 2 ORDER BY o_orderkey) AS rn FROM orders""")
_STEP = """CASE status WHEN 'final' THEN r + coalesce(dur, 85) + 10
  WHEN 'live' THEN coalesce(now_min, r) + greatest(12.0, 85.0 - coalesce(dur, 42.5)) + 10
  ELSE greatest(r, coalesce(now_min, r), coalesce(explicit_at, r)) + 95 END"""


@query("court_estimates", f"""
WITH RECURSIVE chain AS (
  SELECT tournament, day, court, rn, ordinal, status, dur, now_min, explicit_at, CAST(coalesce(court_start, phrase, now_min, 540) AS DOUBLE) AS r FROM fx_courts WHERE rn = 1
  UNION ALL
  SELECT c.tournament, c.day, c.court, c.rn, c.ordinal, c.status, c.dur, c.now_min, c.explicit_at, p.next_r FROM (
    SELECT tournament, day, court, rn, CAST({_STEP} AS DOUBLE) AS next_r FROM chain) p
  JOIN fx_courts c ON c.tournament = p.tournament AND c.day = p.day AND c.court = p.court AND c.rn = p.rn + 1)
SELECT ordinal, CASE WHEN status = 'upcoming' THEN CAST(2 * greatest(r, coalesce(now_min, r), coalesce(explicit_at, r)) AS BIGINT) ELSE -1 END AS half_minutes FROM chain""", ("fx_courts",))
def court_estimates(fx):
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    start = 540 + ck % 97
    clock = F.concat(F.floor(start / 60).cast("string"), F.lit(":"), F.lpad((start % 60).cast("string"), 2, "0"))
    rows = fx.table("orders").select(
        (ck % 97).alias("tournament"), (ck % 3).alias("day"), F.concat(F.lit("Court "), (k % 2).cast("string")).alias("court"), k.alias("ordinal"),
        F.when(ck % 4 != 0, clock).alias("court_start"), pick(k % 4, "Not before 3:00 PM", "Followed by", "Starting at 10:00 AM", None).alias("schedule"),
        F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "live").otherwise("upcoming").alias("status"),
        F.when(k % 3 != 0, 40 + k % 60).alias("dur"), F.when(ck % 3 == 0, 600 + ck % 97).alias("now_min"),
    )
    return sch.estimate_starts(rows, width=500).select("ordinal", F.coalesce((F.col("est_min") * 2).cast("long"), F.lit(-1)).alias("half_minutes"))


# --- brackets ----------------------------------------------------------------------------------------
cte("fx_bracket", """
SELECT source || ':' || tid || ':' || coalesce(class_name, 'Men') AS grp, id, base_round AS round, ordinal, p0 || ' / ' || p1 AS ta, p2 || ' / ' || p3 AS tb,
  CASE base_round WHEN 'Final' THEN 100 WHEN 'Semifinals' THEN 90 WHEN 'Quarterfinals' THEN 80 ELSE 70 END AS rk
FROM fx_feed WHERE base_round <> 'Group A'""", ("fx_feed",))
cte("fx_bracket_ix", """
SELECT b.*, ix, n_rounds FROM fx_bracket b JOIN (
  SELECT grp, round, row_number() OVER (PARTITION BY grp ORDER BY rk, f) - 1 AS ix, count(*) OVER (PARTITION BY grp) AS n_rounds
  FROM (SELECT grp, round, rk, min(ordinal) AS f FROM fx_bracket GROUP BY 1, 2, 3)) USING (grp, round) WHERE n_rounds >= 2""", ("fx_bracket",))
cte("fx_bracket_teams", """
SELECT DISTINCT grp, id, ordinal, ix, n_rounds, unnest([ta, tb]) AS team FROM fx_bracket_ix""", ("fx_bracket_ix",))
cte("fx_fed", """
SELECT t.grp, t.ix, t.id, t.team, f.child FROM fx_bracket_teams t LEFT JOIN (
  SELECT grp, ix + 1 AS ix, team, arg_max(id, ordinal) AS child FROM fx_bracket_teams GROUP BY 1, 2, 3) f
ON f.grp = t.grp AND f.ix = t.ix AND f.team = t.team WHERE t.ix > 0""", ("fx_bracket_teams",))


def bracket_input(fx):
    s = split_category(F.col("class_name"), F.col("round"))
    return fx.feed.select(
        F.concat_ws(":", "source", "tournament.id", s["cls"]).alias("group"), "id", s["round"].alias("round"), "ordinal", "teams"
    )


@query("bracket_edges", """
SELECT grp AS "group", id AS parent_id, child AS child_id, CASE WHEN child IS NULL THEN 'bye' ELSE 'match' END AS kind, min(team) AS team, ix AS round_ix
FROM fx_fed GROUP BY grp, id, child, CASE WHEN child IS NULL THEN team END, ix
UNION ALL
SELECT grp, NULL, id, 'tbd', NULL, ix + 1 FROM fx_bracket_ix b WHERE ix < n_rounds - 1
  AND NOT EXISTS (SELECT 1 FROM fx_fed f WHERE f.grp = b.grp AND f.child = b.id)""", ("fx_fed", "fx_bracket_ix"))
def bracket_edges(fx):
    return ar.bracket_edges(bracket_input(fx), project=True).withColumn("round_ix", F.col("round_ix").cast("long"))


@query("bracket_rounds", """
SELECT grp AS "group", id, ix AS round_ix FROM fx_bracket_ix""", ("fx_bracket_ix",))
def bracket_rounds(fx):
    return ar.round_index(bracket_input(fx)).select("group", "id", F.col("round_ix").cast("long").alias("round_ix"))


# --- timeline -------------------------------------------------------------------------------------------
@query("timeline", f"""
WITH cal AS (SELECT key, CASE WHEN ordinal % 3 = 0 THEN '' ELSE 'Cal ' END || name AS name, start, "end", 'C' || (ordinal % 7) AS city, 'Premier Padel' AS tour, 'P1' AS category, lower(replace(CASE WHEN ordinal % 3 = 0 THEN '' ELSE 'Cal ' END || name, ' ', '')) AS k FROM fx_archive_index),
live AS (SELECT upper(CASE WHEN ordinal % 2 = 0 THEN '' ELSE 'Live ' END || name) AS name, start, start + 5 AS "end", n % 2 = 0 AS live, lower(replace(CASE WHEN ordinal % 2 = 0 THEN '' ELSE 'Live ' END || name, ' ', '')) AS k FROM fx_archive_index),
j AS (SELECT coalesce(c.name, l.name) AS name, CASE WHEN c.k IS NULL THEN l.start ELSE c.start END AS start, CASE WHEN c.k IS NULL THEN l."end" ELSE c."end" END AS "end",
  c.city, coalesce(c.tour, 'FIP') AS tour, coalesce(c.category, 'FIP') AS category, coalesce(l.live, FALSE) AS seen FROM cal c FULL OUTER JOIN live l ON c.k = l.k)
SELECT name, strftime(start, '%Y-%m-%d') AS start, strftime("end", '%Y-%m-%d') AS "end", city, tour, category,
  seen OR (start <= DATE '{TODAY}' AND "end" >= DATE '{TODAY}') AS live,
  CASE WHEN seen OR (start <= DATE '{TODAY}' AND "end" >= DATE '{TODAY}') THEN 'On now' WHEN "end" < DATE '{TODAY}' THEN 'Finished'
    WHEN start - DATE '{TODAY}' = 0 THEN 'Today' WHEN start - DATE '{TODAY}' = 1 THEN 'Tomorrow' ELSE 'in ' || (start - DATE '{TODAY}') || ' days' END AS when_label
FROM j WHERE "end" >= DATE '{TODAY}' - 3""", IDX)
def timeline(fx):
    cal = fx.archive_index.select(
        "ordinal", F.concat(F.when(F.col("ordinal") % 3 == 0, "").otherwise("Cal "), F.col("name")).alias("name"), "start", "end", F.concat(F.lit("C"), (F.col("ordinal") % 7).cast("string")).alias("city"),
        F.lit("ES").alias("country"), F.lit("Premier Padel").alias("tour"), F.lit("P1").alias("category"),
    )
    live = fx.archive_index.select(
        F.upper(F.concat(F.when(F.col("ordinal") % 2 == 0, "").otherwise("Live "), F.col("name"))).alias("name"), "start", F.date_add("start", 5).alias("end"), (F.col("n") % 2 == 0).alias("live"),
        F.lit("FIP").alias("tour"), F.lit("FIP").alias("category"),
    )
    return ar.timeline(cal, live, today()).select("name", d("start"), d("end"), "city", "tour", "category", "live", "when_label")


# --- historic rows ------------------------------------------------------------------------------------------
@query("historic_matches", """
SELECT key, class_name, round, winners, losers, row_number() OVER (PARTITION BY key ORDER BY g, pos) AS place FROM (
  SELECT 'wpt-' || tkey AS key, class AS class_name, 'Final' AS round, 'W' || id AS winners, 'L' || id AS losers, CASE class WHEN 'Men' THEN 0 ELSE 1 END AS g, -1 AS pos FROM fx_matches WHERE round = 'Final' QUALIFY id = max(id) OVER (PARTITION BY tkey)
  UNION ALL SELECT 'wpt-' || tkey, class, round, 'W' || id, 'L' || id, CASE class WHEN 'Men' THEN 0 ELSE 1 END, id FROM fx_matches WHERE round <> 'Final')""", ("fx_matches",))
def historic_matches(fx):
    from pyspark.sql import Window

    k = F.col("id").cast("string")
    rows = fx.matches.select(
        F.concat(F.lit("wpt-"), F.col("tkey").cast("string")).alias("key"), F.col("class").alias("gender"), "round", F.col("id").alias("ordinal"),
        F.array(F.concat(F.lit("W"), k)).alias("winners"), F.array(F.concat(F.lit("L"), k)).alias("losers"),
        F.array().cast("array<struct<a:string,b:string>>").alias("sets"),
    )
    finals = best_row(rows.where("round = 'Final'"), ["key"], [F.col("ordinal")]).withColumnRenamed("losers", "runners_up")
    out = nm.historic_matches(finals, rows.where("round <> 'Final'"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("place")).cast("long")
    return out.select("key", "class_name", "round", F.col("teams")[0]["name"].alias("winners"), F.col("teams")[1]["name"].alias("losers"), place.alias("place"))


@query("round_order", """
SELECT id, round, CASE round WHEN 'Final' THEN 7 WHEN 'Round of 16' THEN 4 WHEN 'Round of 32' THEN 3 ELSE 0 END AS round_order FROM fx_matches""", ("fx_matches",))
def round_order(fx):
    return ar.round_order(fx.matches.select("id", "round"), lk.ROUND_ORDER_DRAWS)


@query("append_labels", """
SELECT tkey, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons FROM (
  SELECT tkey, CAST(year(match_date) AS VARCHAR) AS season FROM fx_matches UNION ALL SELECT tkey, CAST(year(match_date) + id % 2 AS VARCHAR) FROM fx_matches) GROUP BY 1""", ("fx_matches",))
def append_labels(fx):
    season = lambda add: (F.year("match_date") + add).cast("string").alias("season")
    old, new = fx.matches.select("tkey", season(0)), fx.matches.select("tkey", season(F.col("id") % 2))
    return ar.append_labels(old, new, ["tkey"], "season").select("tkey", F.concat_ws(",", "seasons").alias("seasons"))
