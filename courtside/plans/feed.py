"""Feed operators: merge, filters, overview, day strip, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions.labels import schedule_label
from courtside.operators import feed as f, filters as fl
from courtside.plans.fixtures import TODAY, today
from courtside.plans.registry import cte, query

FEED = ("fx_feed",)
d = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
long = lambda c: F.col(c).cast("long").alias(c)

# --- merge ---------------------------------------------------------------------------------
# two deliveries: every match, then every match again with another status, half of them under a new id
cte("fx_two_feeds", """
SELECT id, status, coalesce(start_time, '') AS st, 0 AS source_rank, ordinal FROM fx_feed
UNION ALL SELECT CASE WHEN k % 2 = 0 THEN '' ELSE 'again:' END || id, 'final', coalesce(start_time, ''), 1, ordinal FROM fx_feed""", FEED)


def two_feeds(fx):
    again = fx.feed.withColumn("status", F.lit("final")).withColumn(
        "id", F.concat(F.when(F.col("ordinal") % 2 == 0, "").otherwise("again:"), F.col("id"))
    )
    return f.union_feeds([fx.feed, again])


@query("merge_feeds", """
SELECT id, arg_max(status, source_rank * 1000000000 + ordinal) AS status, min(source_rank * 1000000000 + ordinal) AS first_place
FROM fx_two_feeds GROUP BY 1""", ("fx_two_feeds",))
def merge_feeds(fx):
    place = F.col("first_seen.source_rank").cast("long") * 1000000000 + F.col("first_seen.ordinal")
    return f.merge_feeds(two_feeds(fx)).select("id", "status", place.alias("first_place"))


@query("feed_order", """
SELECT id, CASE status WHEN 'live' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END AS state, coalesce(st, '') AS start, first_place FROM (
  SELECT id, arg_max(status, source_rank * 1000000000 + ordinal) AS status, arg_max(st, source_rank * 1000000000 + ordinal) AS st,
    min(source_rank * 1000000000 + ordinal) AS first_place FROM fx_two_feeds GROUP BY 1)""", ("fx_two_feeds",))
def feed_order(fx):
    """The whole feed in order, each row with the keys of its place."""
    state, start, seen = f.feed_order()
    rows = f.merge_feeds(two_feeds(fx)).orderBy(state, start, seen)
    place = F.col("first_seen.source_rank").cast("long") * 1000000000 + F.col("first_seen.ordinal")
    return rows.select("id", state.cast("long").alias("state"), start.alias("start"), place.alias("first_place"))


@query("union_feeds", """
SELECT source_rank, count(*) AS n, CAST(sum(ordinal) AS BIGINT) AS ordinals FROM fx_two_feeds GROUP BY 1""", ("fx_two_feeds",))
def union_feeds(fx):
    return two_feeds(fx).groupBy("source_rank").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


@query("best_variant", """
SELECT event_id, header, CAST(ordinal AS BIGINT) AS ordinal, n_sets FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, header, pa ORDER BY CASE WHEN n_sets <= 3 THEN n_sets ELSE -n_sets END DESC, ordinal) AS rn
  FROM (SELECT l_orderkey AS event_id, 'H' || (l_linenumber % 3) AS header, 'P' || (l_suppkey % 4) AS pa,
          l_partkey * 1000 + l_suppkey AS o0, CAST(l_quantity AS BIGINT) % 5 AS n_sets,
          l_partkey * 100000000 + l_suppkey * 10000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS ordinal FROM lineitem)) WHERE rn = 1""")
def best_variant(fx):
    n = F.col("l_quantity").cast("long") % 5
    rows = fx.table("lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.concat(F.lit("H"), (F.col("l_linenumber") % 3).cast("string")).alias("header"),
        F.array(F.concat(F.lit("P"), (F.col("l_suppkey") % 4).cast("string"))).alias("players_a"), F.array(F.lit("X")).alias("players_b"),
        F.array_repeat(F.lit("6-4"), n.cast("int")).alias("sets"),
        (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 10000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("ordinal"),
    )
    return f.best_variant(rows).select("event_id", "header", "ordinal", F.size("sets").cast("long").alias("n_sets"))


@query("distinct_tournaments", """
SELECT source, tid, arg_min(id, ordinal) AS first_match FROM fx_feed GROUP BY 1, 2""", FEED)
def distinct_tournaments(fx):
    rows = fx.feed.select("source", F.col("tournament.id").alias("tid"), "id", "ordinal")
    return f.distinct_first(rows, ["source", "tid"]).select("source", "tid", F.col("id").alias("first_match"))


# --- tallies -----------------------------------------------------------------------------------
@query("tally_status", "SELECT status, count(*) AS n FROM fx_feed GROUP BY 1", FEED)
def tally_status(fx):
    return f.tally(fx.feed, "status")


@query("tally_status_and_federation", """
SELECT 'status' AS axis, status AS value, count(*) AS n FROM fx_feed GROUP BY 2
UNION ALL SELECT 'federation', federation, count(*) FROM fx_feed GROUP BY 2""", FEED)
def tally_both(fx):
    return f.tally_both(fx.feed)


@query("source_status", """
SELECT source, count(id) AS count, bool_and(ok) AS ok, max(CASE WHEN NOT ok THEN error END) AS error FROM (
  SELECT source, CASE WHEN k % 50 = 0 THEN NULL ELSE id END AS id, NOT (source = 'fip' AND k % 50 = 0) AS ok, 'down ' || source AS error FROM fx_feed) GROUP BY 1""", FEED)
def source_status(fx):
    fail = (F.col("ordinal") % 50 == 0)
    rows = fx.feed.select(
        "source", F.when(~fail, F.col("id")).alias("id"), (~((F.col("source") == "fip") & fail)).alias("ok"),
        F.concat(F.lit("down "), F.col("source")).alias("error"),
    )
    return f.source_status(rows)


# --- filters -------------------------------------------------------------------------------------
@query("feed_filter", """
SELECT id FROM fx_feed WHERE status = 'live' AND federation = 'FIP'
  AND contains(lower(tname || ' ' || p0 || ' / ' || p1 || ' ' || p2 || ' / ' || p3 || ' ' || coalesce(class_name, '')), 'gold')""", FEED)
def feed_filter(fx):
    return fl.filter_feed(fx.feed, today(), status="live", fed="FIP", q=" Gold ").select("id")


_MATCH_DAY = f"""CASE WHEN start_time IS NOT NULL THEN CAST(substr(start_time, 1, 10) AS DATE)
  WHEN day_n IS NOT NULL THEN (
    SELECT arg_min(x, abs(date_diff('day', DATE '{TODAY}', x))) FROM (
      SELECT make_date(y, month(d), day(d)) AS x FROM (VALUES (1998), (1997), (1999)) t(y)
      WHERE NOT (month(d) = 2 AND day(d) = 29)) WHERE dayofweek(x) = dayofweek(d)) END"""
cte("fx_feed_days", f"""
SELECT *, coalesce({_MATCH_DAY}, CASE WHEN day_n IS NOT NULL AND NOT (month(d) = 2 AND day(d) = 29) THEN make_date(1998, month(d), day(d)) END) AS md FROM fx_feed""", FEED)


@query("match_date", "SELECT id, strftime(md, '%Y-%m-%d') AS md FROM fx_feed_days", ("fx_feed_days",))
def match_date(fx):
    md = f.match_date(F.col("start_time"), F.col("day.label"), today())
    return fx.feed.select("id", F.date_format(md, "yyyy-MM-dd").alias("md"))


@query("feed_filter_day", f"SELECT id FROM fx_feed_days WHERE md = DATE '{TODAY}'", ("fx_feed_days",))
def feed_filter_day(fx):
    return fl.filter_feed(fx.feed, today(), day=TODAY).select("id")


@query("day_strip", f"""
WITH counts AS (SELECT md, count(*) AS n FROM fx_feed_days WHERE md IS NOT NULL AND status <> 'final' AND status = 'upcoming' GROUP BY 1),
span AS (SELECT least(coalesce(min(md), DATE '{TODAY}'), DATE '{TODAY}') AS lo, greatest(coalesce(max(md), DATE '{TODAY}'), DATE '{TODAY}') AS hi
         FROM counts WHERE md BETWEEN DATE '{TODAY}' - 9 AND DATE '{TODAY}' + 21)
SELECT strftime(x, '%Y-%m-%d') AS day, strftime(x, '%a') AS weekday, strftime(x, '%d.%m') AS label, coalesce(n, 0) AS n, x = DATE '{TODAY}' AS is_today
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS x FROM span) LEFT JOIN counts ON md = x""", ("fx_feed_days",))
def day_strip(fx):
    return f.day_strip(fx.feed, today(), status="upcoming").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- overview -----------------------------------------------------------------------------------------
_TIER = "CASE word WHEN 'Major' THEN 100 WHEN 'P1' THEN 90 WHEN 'P2' THEN 80 WHEN 'Gold' THEN 70 WHEN 'Silver' THEN 60 WHEN 'Bronze' THEN 50 ELSE 0 END"
_KO = "base_round IN ('Final','Semifinals','Quarterfinals','Round of 16')"
cte("fx_feed_players", """
SELECT DISTINCT source || ':' || tid AS key, unnest([p0, p1, p2, p3]) AS player FROM fx_feed""", FEED)
cte("fx_competitions", f"""
SELECT b.*, p.players FROM (
  SELECT source || ':' || tid AS key, arg_min(tname, ordinal) AS name, min(source) AS source, arg_min(federation, ordinal) AS federation,
    count(*) AS matches, count(*) FILTER (status = 'live') AS live, count(*) FILTER (status = 'upcoming') AS upcoming,
    CASE WHEN bool_or({_KO}) THEN 'Tournament' WHEN min(word) = 'Liga' THEN 'League' ELSE 'Tournament' END AS format, min({_TIER}) AS tier
  FROM fx_feed GROUP BY 1) b JOIN (SELECT key, count(*) AS players FROM fx_feed_players GROUP BY 1) p USING (key)""", ("fx_feed", "fx_feed_players"))


@query("competitions", "SELECT * FROM fx_competitions", ("fx_competitions",))
def competitions(fx):
    return f.competitions(fx.feed)


@query("competition_order", """
SELECT key, name FROM fx_competitions ORDER BY live > 0 DESC, tier DESC, matches DESC, name, key""", ("fx_competitions",))
def competition_order(fx):
    return f.competitions(fx.feed).orderBy(*f.competition_order()).select("key", "name")


@query("competition_filter", """
SELECT key, name FROM fx_competitions WHERE federation = 'FIP' AND contains(lower(name), 'silver')""", ("fx_competitions",))
def competition_filter(fx):
    return fl_comp(f.competitions(fx.feed)).select("key", "name")


def fl_comp(c):
    return f.filter_competitions(c, fed="FIP", q="Silver")


@query("tournament_header", """
SELECT source || ':' || tid AS key, count(*) AS matches, min(substr(start_time, 1, 10)) AS first_day, max(substr(start_time, 1, 10)) AS last_day,
  count(*) FILTER (status = 'live') AS live, min(p.players) AS players
FROM fx_feed JOIN (SELECT key, count(*) AS players FROM fx_feed_players GROUP BY 1) p ON p.key = source || ':' || tid GROUP BY 1""", ("fx_feed", "fx_feed_players"))
def tournament_header(fx):
    return f.tournament_header(fx.feed)


@query("live_event_spans", """
SELECT tname AS name, strftime(min(md), '%Y-%m-%d') AS start, strftime(max(md), '%Y-%m-%d') AS "end", bool_or(status = 'live') AS live, 'FIP' AS tour,
  CASE min(word) WHEN 'Liga' THEN 'FIP' WHEN 'Open' THEN 'FIP' ELSE min(word) END AS category
FROM fx_feed_days WHERE source = 'fip' AND md IS NOT NULL GROUP BY 1""", ("fx_feed_days",))
def live_event_spans(fx):
    return f.live_spans(fx.feed, today()).withColumn("start", d("start")).withColumn("end", d("end"))


# --- layouts ---------------------------------------------------------------------------------------------
@query("group_layout", f"""
SELECT g.federation, section_label AS section, events, CAST(section_matches AS BIGINT) AS section_matches, key, name, matches, live, rank FROM (
  SELECT federation, federation AS f0, CASE WHEN federation = 'FIP' THEN 'FIP International' ELSE federation END AS section_label,
    key, name, matches, live, tier * 1000 + matches AS rank FROM fx_competitions) g
JOIN (SELECT federation, count(*) AS events, sum(matches) AS section_matches FROM fx_competitions GROUP BY 1) s ON s.federation = g.federation""", ("fx_competitions",))
def group_layout(fx):
    return f.group_layout(fx.feed).select(
        "federation", "section", "events", "section_matches", "key", "name", "matches", "live", "rank"
    )


@query("group_order", """
SELECT key, federation FROM (SELECT key, federation, matches, tier, first_seen FROM fx_competitions JOIN (
  SELECT source || ':' || tid AS key, min(ordinal) AS first_seen FROM fx_feed GROUP BY 1) USING (key))
ORDER BY CASE WHEN federation = 'FIP' THEN '' ELSE federation END, federation, tier * 1000 + matches DESC, first_seen""", ("fx_competitions", "fx_feed"))
def group_order(fx):
    return f.group_layout(fx.feed).orderBy(*f.group_order()).select("key", "federation")


_MINUTE = """CASE WHEN status <> 'upcoming' THEN 0
  WHEN est_start IS NOT NULL THEN CAST(substr(est_start, 1, 2) AS INT) * 60 + 30
  WHEN start_time IS NOT NULL THEN CAST(substr(start_time, 12, 2) AS INT) * 60
  WHEN schedule LIKE 'Not%' THEN 900 WHEN schedule LIKE 'Starting%' THEN 600 END"""


_GROUPS = f"""
SELECT source || ':' || tid AS key, id, row_number() OVER (PARTITION BY source, tid ORDER BY CASE status WHEN 'live' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END,
  {_MINUTE} NULLS LAST, ordinal) AS rn FROM fx_feed"""


@query("group_matches_all", _GROUPS, FEED)
def group_matches_all(fx):
    return f.group_matches(fx.feed, None).select("key", "id", F.col("rn").cast("long").alias("rn"))


@query("group_matches", f"SELECT key, id, rn FROM ({_GROUPS}) WHERE rn <= 20", FEED)
def group_matches(fx):
    return f.group_matches(fx.feed).select("key", "id", F.col("rn").cast("long").alias("rn"))


@query("start_order", f"""
SELECT id, CAST({_MINUTE} AS VARCHAR) AS minute FROM fx_feed WHERE status = 'upcoming'""", FEED)
def start_order(fx):
    from courtside.functions.labels import start_minute

    m = start_minute(F.col("est_start"), F.col("start_time"), F.col("schedule"))
    return fx.feed.where("status = 'upcoming'").select("id", m.cast("int").cast("string").alias("minute"))


@query("schedule_label", """
SELECT id, CASE WHEN start_time IS NOT NULL THEN substr(start_time, 12, 5) WHEN schedule LIKE 'Not%' THEN '~15:00' WHEN schedule LIKE 'Starting%' THEN '10:00'
  WHEN est_start IS NOT NULL THEN '≈' || est_start WHEN schedule LIKE 'Follow%' THEN 'next' END AS label FROM fx_feed""", FEED)
def schedule_label_(fx):
    return fx.feed.select("id", schedule_label(F.col("start_time"), F.col("schedule"), F.col("est_start")).alias("label"))


@query("draw_layout", """
SELECT source || ':' || tid AS key, coalesce(class_name, 'Men') AS cls, base_round AS round_name,
  CASE base_round WHEN 'Final' THEN 100 WHEN 'Semifinals' THEN 90 WHEN 'Quarterfinals' THEN 80 WHEN 'Round of 16' THEN 70 ELSE 20 END AS rank,
  count(*) AS matches, min(ordinal) AS first_seen, min(min(ordinal)) OVER (PARTITION BY source, tid, coalesce(class_name, 'Men')) AS class_seen
FROM fx_feed GROUP BY source, tid, coalesce(class_name, 'Men'), base_round""", FEED)
def draw_layout(fx):
    return f.draw_groups(fx.feed)


@query("by_day_layout", """
SELECT key, day_key, CASE WHEN day_key = 'tbc' THEN 'Date TBC' ELSE 'Day ' || CASE WHEN day_key LIKE 'd%' THEN substr(day_key, 2) ELSE CAST(rn AS VARCHAR) END || ' · ' || label END AS heading, matches FROM (
  SELECT key, day_key, arg_min(label, ordinal) AS label, count(*) AS matches, row_number() OVER (PARTITION BY key ORDER BY kind, n, x) AS rn FROM (
    SELECT ordinal, source || ':' || tid AS key, CASE WHEN day_n IS NOT NULL THEN 0 WHEN start_time IS NOT NULL THEN 1 ELSE 2 END AS kind, day_n AS n, CAST(substr(start_time, 1, 10) AS DATE) AS x,
      CASE WHEN day_n IS NOT NULL THEN 'd' || day_n ELSE coalesce(substr(start_time, 1, 10), 'tbc') END AS day_key,
      CASE WHEN day_n IS NOT NULL THEN upper(strftime(d, '%b %d %a')) ELSE strftime(CAST(substr(start_time, 1, 10) AS DATE), '%a %-d %b') END AS label
    FROM fx_feed) GROUP BY key, day_key, kind, n, x)""", FEED)
def by_day_layout(fx):
    return f.day_groups(fx.feed).select("key", "day_key", "heading", "matches")


@query("find_tournament", """
SELECT source, tid AS id, CASE WHEN a.key IS NOT NULL THEN 'archive' ELSE 'live' END AS origin, coalesce(a.name, l.tname) AS name,
  coalesce(a.federation, l.federation) AS federation FROM (
  SELECT source, tid, arg_min(tname, ordinal) AS tname, arg_min(federation, ordinal) AS federation FROM fx_feed GROUP BY 1, 2) l
LEFT JOIN (SELECT replace(key, 'rin-', CASE WHEN ordinal % 2 = 0 THEN 'fip-' ELSE 'old-' END) AS key, 'Archive ' || name AS name, federation FROM fx_archive_index) a ON a.key = source || '-' || tid""",
       ("fx_feed", "fx_archive_index"))
def find_tournament(fx):
    none = F.lit(None).cast("string")
    arch = fx.archive_index.select(
        F.replace("key", F.lit("rin-"), F.when(F.col("ordinal") % 2 == 0, "fip-").otherwise("old-")).alias("key"), F.concat(F.lit("Archive "), F.col("name")).alias("name"), "federation",
        "start", "end", *[none.alias(c) for c in ("venue", "address", "organizer", "organizer_url")],
    )
    keys = fx.feed.select("source", F.col("tournament.id").alias("id")).distinct()
    return f.find_tournament(keys, arch, fx.feed).select("source", "id", "origin", "name", "federation")
