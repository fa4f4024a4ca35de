"""Ranking lists derived from events, eras and season standings."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions.dates import iso_week
from courtside.functions.labels import era_label, movement_label
from courtside.operators import archive as ar, filters as fl, rankings as r, schedule as sch
from courtside.plans.registry import cte, query

ts = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
text = lambda c: F.col(c).cast("string").alias(c)
D = "strftime({0}, '%Y-%m-%d') AS {0}"


@query("ranking_flatten", """
SELECT strftime(snapshot_at, '%Y-%m-%d') AS snapshot_at, fed, category, id, rank FROM fx_ranking_rows WHERE id IS NOT NULL""", ("fx_ranking_rows",))
def ranking_flatten(fx):
    return r.flatten_ranks(fx.ranking_rows, ["snapshot_at"]).withColumn("snapshot_at", ts("snapshot_at")).withColumn("rank", F.col("rank").cast("long"))


# the previous day's lists against the newest ones
_STATE = """CASE WHEN NOT movement THEN NULL WHEN id IS NULL THEN 'untracked' WHEN base_rank IS NULL THEN 'new'
  WHEN base_rank > rank THEN 'up' WHEN base_rank < rank THEN 'down' ELSE 'same' END"""


@query("rank_movement", f"""
WITH base AS (SELECT * FROM fx_ranking_rows WHERE snapshot_at = (SELECT max(snapshot_at) FROM fx_ranking_rows) - INTERVAL 1 DAY AND fed <> 'view')
SELECT c.fed, c.category, c.rank, c.name, b.fed IS NOT NULL AS movement, CAST(CASE WHEN c.id IS NOT NULL THEN p.rank - c.rank END AS VARCHAR) AS delta,
  CASE WHEN b.fed IS NULL THEN NULL WHEN c.id IS NULL THEN 'untracked' WHEN p.rank IS NULL THEN 'new'
    WHEN p.rank > c.rank THEN 'up' WHEN p.rank < c.rank THEN 'down' ELSE 'same' END AS movement_state
FROM fx_last_lists c LEFT JOIN (SELECT DISTINCT fed, category FROM base WHERE id IS NOT NULL) b ON b.fed = c.fed AND b.category = c.category
LEFT JOIN base p ON p.fed = c.fed AND p.category = c.category AND p.id = c.id""", ("fx_last_lists",))
def rank_movement(fx):
    newest = fx.ranking_rows.agg(F.max("snapshot_at")).scalar()
    prev = fx.ranking_rows.where(
        (F.col("snapshot_at") == newest - F.make_dt_interval(days=F.lit(1))) & (F.col("fed") != "view")
    )
    return r.rank_movement(fx.last_lists, r.flatten_ranks(prev)).select(
        "fed", "category", F.col("rank").cast("long").alias("rank"), "name", "movement", text("delta"), "movement_state"
    )


cte("fx_weekly", """
WITH snaps AS (SELECT DISTINCT snapshot_at, strftime(snapshot_at, '%G-W%V') AS week FROM fx_ranking_rows),
weeks AS (SELECT week, min(snapshot_at) AS first_at, max(snapshot_at) AS last_at FROM snaps GROUP BY 1),
bases AS (SELECT week, coalesce(lag(last_at) OVER (ORDER BY first_at), first_at) AS base_at, lag(last_at) OVER (ORDER BY first_at) IS NULL AS seed FROM weeks),
plan AS (SELECT s.snapshot_at, s.week, CASE WHEN NOT (seed AND s.snapshot_at = base_at) THEN base_at END AS base_at FROM snaps s JOIN bases USING (week))
SELECT c.snapshot_at, c.fed, c.category, c.rank, c.id, c.name, l.fed IS NOT NULL AS movement, p.rank AS base_rank
FROM fx_ranking_rows c JOIN plan ON plan.snapshot_at = c.snapshot_at
LEFT JOIN (SELECT DISTINCT snapshot_at, fed, category FROM fx_ranking_rows WHERE id IS NOT NULL) l ON l.snapshot_at = plan.base_at AND l.fed = c.fed AND l.category = c.category
LEFT JOIN fx_ranking_rows p ON p.snapshot_at = plan.base_at AND p.fed = c.fed AND p.category = c.category AND p.id = c.id""", ("fx_ranking_rows",))


@query("weekly_movement", f"""
SELECT strftime(snapshot_at, '%Y-%m-%d') AS snapshot_at, fed, category, rank, name, movement,
  CAST(CASE WHEN movement AND id IS NOT NULL THEN base_rank - rank END AS VARCHAR) AS delta, {_STATE} AS movement_state FROM fx_weekly""", ("fx_weekly",))
def weekly_movement(fx):
    return r.weekly_movement(fx.ranking_rows).select(
        ts("snapshot_at"), "fed", "category", F.col("rank").cast("long").alias("rank"), "name", "movement", text("delta"), "movement_state"
    )


@query("movement_label", f"""
SELECT strftime(snapshot_at, '%Y-%m-%d') AS snapshot_at, fed, category, name,
  CASE WHEN NOT movement THEN '' WHEN id IS NULL THEN '·' WHEN base_rank IS NULL THEN 'NEW' WHEN base_rank > rank THEN '▲' || (base_rank - rank)
    WHEN base_rank < rank THEN '▼' || (rank - base_rank) ELSE '–' END AS label FROM fx_weekly""", ("fx_weekly",))
def movement_label_(fx):
    m = r.weekly_movement(fx.ranking_rows)
    return m.select(ts("snapshot_at"), "fed", "category", "name", movement_label(F.col("movement"), F.col("movement_state"), F.col("delta")).alias("label"))


@query("next_baseline", """
SELECT '2024-W06' AS week_of, fed, category, id, rank FROM fx_last_lists WHERE id IS NOT NULL""", ("fx_last_lists",))
def next_baseline(fx):
    old = fx.ranking_rows.where(F.col("snapshot_at") == F.lit("2024-01-02").cast("timestamp_ntz"))
    base = r.flatten_ranks(old).withColumn("week_of", F.lit("2024-W01"))
    out = r.next_baseline(base, fx.last_lists, old, "2024-W06")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("iso_week", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def iso_week_(fx):
    o = fx.table("orders").select("o_orderdate").distinct()
    return o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), iso_week(F.col("o_orderdate")).alias("week"))


@query("player_ranks", """
SELECT id, fed, category, rank, row_number() OVER (PARTITION BY id ORDER BY rank, fed, category) AS place FROM fx_last_lists WHERE id IS NOT NULL""", ("fx_last_lists",))
def player_ranks(fx):
    return r.player_ranks(fx.last_lists).select(
        "id", "fed", "category", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place")
    )


cte("fx_defended", "SELECT *, CAST(floor(points * 10) AS BIGINT) % 40 AS defending FROM fx_last_lists", ("fx_last_lists",))


@query("race_to_the_top", """
SELECT fed, category, place, name, round(leader - points, 2) AS gap FROM (
  SELECT *, first_value(points) OVER w AS leader, row_number() OVER w AS place, count(*) OVER (PARTITION BY fed, category) AS n FROM fx_last_lists
  WINDOW w AS (PARTITION BY fed, category ORDER BY rank)) WHERE place <= 5 AND n >= 2""", ("fx_last_lists",))
def race(fx):
    rows = fx.last_lists.withColumn("defending", F.floor(F.col("points") * 10) % 40)
    return r.race(rows).select(
        "fed", "category", F.col("place").cast("long").alias("place"), "name", F.round("gap", 2).alias("gap")
    )


@query("nationality_counts", """
SELECT fed, category, country, count(*) AS n FROM fx_last_lists GROUP BY 1, 2, 3
QUALIFY count(*) OVER (PARTITION BY fed, category) > 1""", ("fx_last_lists",))
def nationality_counts(fx):
    return r.nationalities(fx.last_lists)


@query("ranking_filter", """
SELECT fed, category, rank, name FROM fx_last_lists WHERE (contains(lower(name), 'p1') OR contains(lower(club), 'p1')) AND country = 'C1'""", ("fx_last_lists",))
def ranking_filter(fx):
    return fl.ranking_filter(fx.last_lists, q="P1", country="C1").select("fed", "category", F.col("rank").cast("long").alias("rank"), "name")


@query("ranking_list_all", "SELECT fed, category, rank, name, row_number() OVER (PARTITION BY fed, category ORDER BY rank) AS rn FROM fx_last_lists", ("fx_last_lists",))
def ranking_list_all(fx):
    return r.list_rows(fx.last_lists, None).select("fed", "category", F.col("rank").cast("long").alias("rank"), "name", F.col("rn").cast("long").alias("rn"))


@query("ranking_list_rows", """
SELECT fed, category, rank, name FROM (SELECT *, row_number() OVER (PARTITION BY fed, category ORDER BY rank) AS rn FROM fx_last_lists) WHERE rn <= 20""", ("fx_last_lists",))
def ranking_list_rows(fx):
    return r.list_rows(fx.last_lists, 20).select("fed", "category", F.col("rank").cast("long").alias("rank"), "name")


@query("ranking_page_all", """
SELECT strftime(snapshot_at, '%Y-%m-%d') AS snapshot_at, fed, category, rank FROM fx_ranking_rows""", ("fx_ranking_rows",))
def ranking_page_all(fx):
    return r.page(fx.ranking_rows, None).select(ts("snapshot_at"), "fed", "category", F.col("rank").cast("long").alias("rank"))


@query("ranking_page", """
SELECT snapshot_at, fed, category, rank FROM (
  SELECT strftime(snapshot_at, '%Y-%m-%d') AS snapshot_at, fed, category, rank, row_number() OVER (PARTITION BY fed, category ORDER BY rank) AS rn FROM fx_last_lists) WHERE rn <= 250""", ("fx_last_lists",))
def ranking_page(fx):
    return r.page(fx.last_lists).select(ts("snapshot_at"), "fed", "category", F.col("rank").cast("long").alias("rank"))


@query("points_at_risk", """
SELECT fed, category, id, round(sum(CASE WHEN ends >= DATE '2024-12-30' THEN points ELSE 0 END), 2) AS points,
  round(sum(CASE WHEN ends BETWEEN DATE '2024-12-30' AND DATE '2024-12-30' + 56 THEN points ELSE 0 END), 2) AS defending
FROM (SELECT fed, category, coalesce(id, -1) AS id, points, CAST(snapshot_at AS DATE) + 364 AS ends FROM fx_ranking_rows) GROUP BY 1, 2, 3""", ("fx_ranking_rows",))
def points_at_risk(fx):
    awards = fx.ranking_rows.select(
        "fed", "category", F.coalesce("id", F.lit(-1)).alias("id"), "points", F.col("snapshot_at").cast("date").alias("award_date")
    )
    out = r.points_at_risk(awards, F.lit("2024-12-30").cast("date"))
    return out.withColumn("points", F.round("points", 2)).withColumn("defending", F.round("defending", 2))


# --- eras and standings ---------------------------------------------------------------------------
cte("fx_eras", """
SELECT gender, pair, min(year) AS from_year, max(year) AS to_year, count(*) AS years, string_agg(DISTINCT authority, ',' ORDER BY authority) AS sources FROM (
  SELECT *, sum(CASE WHEN pair = pp AND year - 1 = py THEN 0 ELSE 1 END) OVER (PARTITION BY gender ORDER BY year) AS era FROM (
    SELECT *, lag(pair) OVER w AS pp, lag(year) OVER w AS py FROM fx_no1 WINDOW w AS (PARTITION BY gender ORDER BY year)))
GROUP BY gender, era, pair""", ("fx_no1",))


@query("eras", """
SELECT gender, pair, CAST(from_year AS BIGINT) AS from_year, CAST(to_year AS BIGINT) AS to_year, years, sources,
  to_year = (SELECT max(year) FROM fx_no1 n WHERE n.gender = e.gender) AS current,
  CASE WHEN from_year = to_year THEN '' || from_year ELSE from_year || '–' || right('' || to_year, 2) END AS label FROM fx_eras e""", ("fx_eras",))
def eras(fx):
    e = ar.eras(fx.no1)
    big = lambda c: F.col(c).cast("long").alias(c)
    return e.select("gender", "pair", big("from_year"), big("to_year"), big("years"), F.concat_ws(",", "sources").alias("sources"), "current",
                    era_label(F.col("from_year"), F.col("to_year")).alias("label"))


@query("era_search", "SELECT gender, pair, CAST(from_year AS BIGINT) AS from_year FROM fx_eras WHERE contains(lower(pair), 'a')", ("fx_eras",))
def era_search(fx):
    return ar.era_filter(ar.eras(fx.no1), "A").select("gender", "pair", F.col("from_year").cast("long").alias("from_year"))


cte("fx_season_ranking", """
SELECT year, gender, rank, name, points, row_number() OVER (PARTITION BY year, gender ORDER BY rank, name) AS ordinal FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender, o_custkey % 40 AS rank,
    'Player C' || o_custkey AS name, count(*) AS points FROM orders GROUP BY ALL)""")


def season_ranking(fx):
    ck = F.col("o_custkey")
    return fx.table("orders").groupBy(
        F.year("o_orderdate").alias("year"), F.when(ck % 2 == 0, "Men").otherwise("Women").alias("gender"), (ck % 40).alias("rank"),
        F.concat(F.lit("Player C"), ck.cast("string")).alias("name"),
    ).agg(F.count("*").alias("points")).withColumn("ordinal", F.col("name"))


@query("season_standings", """
SELECT year, gender, rank, string_agg(name, ' / ' ORDER BY name) AS names, arg_min(points, name) AS points FROM (
  SELECT *, dense_rank() OVER (PARTITION BY year, gender ORDER BY rank) AS place FROM fx_season_ranking) WHERE place <= 10 GROUP BY 1, 2, 3""", ("fx_season_ranking",))
def season_standings(fx):
    return ar.standings(season_ranking(fx))


@query("inherited_ranks", """
SELECT table_id, ordinal,
  CAST((SELECT arg_max(r2.rank, r2.ordinal) FROM src r2 WHERE r2.table_id = s.table_id AND r2.ordinal <= s.ordinal AND r2.rank IS NOT NULL) AS VARCHAR) AS rank,
  CAST((SELECT arg_max(coalesce(r2.points, -1), r2.ordinal) FROM src r2 WHERE r2.table_id = s.table_id AND r2.ordinal <= s.ordinal AND NOT r2.is_short) AS VARCHAR) AS points
FROM src s""".replace("FROM src s", "FROM src s").replace("src", "fx_rank_table"), ())
def inherited_ranks(fx):
    out = sch.inherit_rank(rank_table(fx))
    return out.select("table_id", "ordinal", text("rank"), F.coalesce("points", F.when(F.col("_any"), -1)).cast("string").alias("points"))


def rank_table(fx):
    e = F.col("event_type")
    t = fx.table("events").select(
        F.col("user_id").alias("table_id"), F.col("event_id").alias("ordinal"),
        F.when(e.isin("click", "purchase"), F.col("event_id") % 100).alias("rank"),
        F.when(e == "click", F.floor("value")).alias("points"), (~e.isin("click", "purchase")).alias("is_short"),
    )
    full = t.where(~F.col("is_short")).groupBy("table_id").agg(F.min("ordinal").alias("_f"))
    return t.join(full, "table_id", "left").withColumn("_any", F.col("ordinal") >= F.col("_f")).drop("_f")


cte("fx_rank_table", """
SELECT user_id AS table_id, event_id AS ordinal, CASE WHEN event_type IN ('click','purchase') THEN event_id % 100 END AS rank,
  CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) END AS points, event_type NOT IN ('click','purchase') AS is_short FROM events""")
from courtside.plans.registry import ORACLES, with_ctes  # noqa: E402

ORACLES["inherited_ranks"] = with_ctes(ORACLES["inherited_ranks"], ("fx_rank_table",))
