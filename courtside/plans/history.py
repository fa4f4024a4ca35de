"""Profiles, partners, head-to-head and search over derived match history."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.operators import history as h
from courtside.plans.registry import cte, query

MP, M, T, AP = "fx_match_players", "fx_matches", "fx_tournaments", "fx_appearances"
DAY = "strftime(match_date, '%Y-%m-%d')"


def day(c: str = "match_date"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query("head_to_head", """
SELECT x.player_id AS a, y.player_id AS b,
  count(*) FILTER (x.side <> y.side) AS opponents,
  count(*) FILTER (x.side <> y.side AND m.winner_side = x.side) AS a_wins,
  count(*) FILTER (x.side <> y.side AND m.winner_side = y.side) AS b_wins,
  count(*) FILTER (x.side = y.side) AS together,
  count(*) FILTER (x.side = y.side AND m.winner_side = x.side) AS together_wins
FROM fx_match_players x JOIN fx_match_players y ON x.match_id = y.match_id AND x.player_id < y.player_id
JOIN fx_matches m ON m.id = x.match_id GROUP BY 1, 2""", (MP, M))
def head_to_head(fx):
    return h.head_to_head(fx.match_players, fx.matches)


@query("head_to_head_list", f"""
SELECT x.match_id, x.player_id AS a, y.player_id AS b, x.side <> y.side AS opponents, {DAY} AS match_date
FROM fx_match_players x JOIN fx_match_players y ON x.match_id = y.match_id AND x.player_id < y.player_id
JOIN fx_matches m ON m.id = x.match_id""", (MP, M))
def head_to_head_list(fx):
    return h.pair_matches(fx.match_players, fx.matches).select("match_id", "a", "b", "opponents", day())


@query("shared_matches", """
SELECT match_id FROM fx_match_players WHERE player_id = 1 INTERSECT SELECT match_id FROM fx_match_players WHERE player_id = 2""", (MP,))
def shared_matches(fx):
    return h.shared_matches(fx.match_players, F.lit(1), F.lit(2))


@query("shared_matches_first", """
SELECT match_id FROM (SELECT match_id FROM fx_match_players WHERE player_id = 1 INTERSECT
SELECT match_id FROM fx_match_players WHERE player_id = 2) ORDER BY match_id LIMIT 100""", (MP,))
def shared_matches_first(fx):
    return h.shared_matches(fx.match_players, F.lit(1), F.lit(2), 100)


@query("match_list", f"""
SELECT player_id, match_id, side, {DAY} AS match_date, round, t.name AS tournament, t.federation
FROM fx_appearances a JOIN fx_tournaments t ON t.tkey = a.tkey""", (AP, T))
def match_list(fx):
    return h.match_list(fx.match_players, fx.matches, fx.tournaments).select(
        "player_id", "match_id", "side", day(), "round", "tournament", "federation"
    )


@query("recent_matches", f"""
SELECT player_id, match_id, rn, {DAY} AS match_date, t.name AS tournament FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) AS rn FROM fx_appearances) a
JOIN fx_tournaments t ON t.tkey = a.tkey WHERE rn <= 60""", (AP, T))
def recent_matches(fx):
    return h.recent_matches(fx.match_players, fx.matches, fx.tournaments).select(
        "player_id", "match_id", F.col("rn").cast("long"), day(), "tournament"
    )


cte("fx_teams", f"""
SELECT m.id AS match_id, coalesce(string_agg('P' || player_id, ' / ' ORDER BY pos) FILTER (side = 1), 'TBD') AS team_1,
  coalesce(string_agg('P' || player_id, ' / ' ORDER BY pos) FILTER (side = 2), 'TBD') AS team_2
FROM fx_matches m LEFT JOIN fx_match_players p ON p.match_id = m.id GROUP BY 1""", (M, MP))


def named(fx):
    return fx.match_players.withColumn("name", F.concat(F.lit("P"), F.col("player_id").cast("string")))


@query("recent_matches_teams", f"""
SELECT player_id, match_id, rn, {DAY} AS match_date, round, score, t.name AS tournament, t.federation, team_1, team_2 FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) AS rn FROM fx_appearances) a
JOIN fx_tournaments t ON t.tkey = a.tkey JOIN fx_teams USING (match_id) WHERE rn <= 60""", (AP, T, "fx_teams"))
def recent_matches_teams(fx):
    """The match list of every player's page, both teams named."""
    rows = h.with_teams(h.recent_matches(fx.match_players, fx.matches, fx.tournaments), named(fx))
    return rows.select(
        "player_id", "match_id", F.col("rn").cast("long"), day(), "round", "score", "tournament", "federation", "team_1", "team_2"
    )


@query("head_to_head_matches", f"""
SELECT a, b, opponents, CAST(row_number() OVER (PARTITION BY a, b, opponents ORDER BY match_date DESC, match_id DESC) AS BIGINT) AS rn, match_id,
  {DAY} AS match_date, round, score, result, t.name AS tournament, t.federation, team_1, team_2 FROM (
  SELECT x.match_id, x.player_id AS a, y.player_id AS b, x.side <> y.side AS opponents, m.match_date, m.round, m.score, m.tkey, m.winner_side = x.side AS result
  FROM fx_match_players x JOIN fx_match_players y ON x.match_id = y.match_id AND x.player_id < y.player_id JOIN fx_matches m ON m.id = x.match_id) p
JOIN fx_tournaments t ON t.tkey = p.tkey JOIN fx_teams USING (match_id)""", (MP, M, T, "fx_teams"))
def head_to_head_matches(fx):
    """Both lists of every pair of players, uncut, with the teams."""
    rows = h.pair_match_list(named(fx), fx.matches, fx.tournaments)
    return rows.select(
        "a", "b", "opponents", F.col("rn").cast("long"), "match_id", day(), "round", "score", "result", "tournament", "federation", "team_1", "team_2"
    )


@query("player_by_year", """
SELECT player_id, CAST(year(match_date) AS INT) AS yr, count(*) AS played, count(*) FILTER (is_winner = 1) AS won
FROM fx_appearances WHERE match_date IS NOT NULL GROUP BY 1, 2""", (AP,))
def player_by_year(fx):
    return h.by_year(fx.match_players, fx.matches)


@query("player_totals", """
SELECT player_id, count(*) AS total, count(*) FILTER (is_winner = 1) AS wins, count(*) FILTER (is_winner <> 1) AS losses
FROM fx_appearances GROUP BY 1""", (AP,))
def player_totals(fx):
    return h.totals(fx.match_players, fx.matches)


@query("titles_and_finals", """
SELECT player_id, count(*) AS finals, count(*) FILTER (is_winner = 1) AS titles
FROM fx_appearances WHERE round = 'Final' GROUP BY 1""", (AP,))
def titles_and_finals(fx):
    return h.titles(fx.match_players, fx.matches)


_SETS = """
SELECT player_id,
  CASE side WHEN 1 THEN string_split(s, '-')[1] ELSE string_split(s, '-')[2] END AS mine,
  CASE side WHEN 1 THEN string_split(s, '-')[2] ELSE string_split(s, '-')[1] END AS theirs
FROM (SELECT player_id, side, unnest(string_split(score, ' ')) AS s FROM fx_appearances WHERE score IS NOT NULL)"""
_G = "CAST(CASE WHEN length({0}) = 2 AND {0}[1] IN ('6','7') THEN {0}[1] ELSE {0} END AS INT)"
SETS_GAMES = f"""
SELECT player_id, CAST(sum(CASE WHEN g > o THEN 1 ELSE 0 END) AS BIGINT) AS sets_won, CAST(sum(CASE WHEN o > g THEN 1 ELSE 0 END) AS BIGINT) AS sets_lost,
  CAST(sum(g) AS BIGINT) AS games_won, CAST(sum(o) AS BIGINT) AS games_lost,
  CAST(floor(100.0 * sum(CASE WHEN g > o THEN 1 ELSE 0 END) / sum(CASE WHEN g <> o THEN 1 ELSE 0 END) + 0.5) AS INT) AS sets_pct,
  CAST(floor(100.0 * sum(g) / sum(g + o) + 0.5) AS INT) AS games_pct
FROM (SELECT player_id, {_G.format('mine')} AS g, {_G.format('theirs')} AS o FROM ({_SETS})) GROUP BY 1"""


@query("sets_and_games", SETS_GAMES, (AP,))
def sets_and_games(fx):
    return h.sets_games(fx.match_players, fx.matches)


_PARTNERS = """
SELECT x.player_id, y.player_id AS partner_id, count(*) AS played, count(*) FILTER (x.is_winner = 1) AS won
FROM fx_match_players x JOIN fx_match_players y ON x.match_id = y.match_id AND x.side = y.side AND x.player_id <> y.player_id
GROUP BY 1, 2"""


@query("partners", _PARTNERS, (MP,))
def partners(fx):
    return h.partners(fx.match_players)


@query("top_partner", f"""
SELECT player_id, partner_id, played, won FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played DESC, won DESC, partner_id) AS rn FROM ({_PARTNERS}))
WHERE rn = 1""", (MP,))
def top_partner(fx):
    return h.top_partner(fx.match_players)


_RANKED = """
SELECT player_id, is_winner, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) AS rn FROM fx_appearances"""
FORM = f"""
SELECT player_id, string_agg(CASE WHEN is_winner = 1 THEN 'W' ELSE 'L' END, '' ORDER BY rn) AS form
FROM ({_RANKED}) WHERE rn <= 12 GROUP BY 1"""
STREAK = f"""
SELECT player_id, count(*) FILTER (broken = 0) AS streak, CASE WHEN max(newest) = 1 THEN 'W' ELSE 'L' END AS streak_type
FROM (SELECT player_id, newest, sum(CASE WHEN is_winner <> newest THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY rn) AS broken
      FROM (SELECT *, first_value(is_winner) OVER (PARTITION BY player_id ORDER BY rn) AS newest FROM ({_RANKED})))
GROUP BY 1"""


@query("recent_form", FORM, (AP,))
def recent_form(fx):
    return h.form(fx.match_players, fx.matches)


@query("current_streak", STREAK, (AP,))
def current_streak(fx):
    return h.streak(fx.match_players, fx.matches)


@query("player_profile", f"""
SELECT p.player_id, t.total, t.wins, t.losses, coalesce(f.titles, 0) AS titles, coalesce(f.finals, 0) AS finals, s.streak, s.streak_type, fo.form,
  coalesce(g.sets_won, 0) AS sets_won, coalesce(g.games_won, 0) AS games_won, CAST(g.sets_pct AS VARCHAR) AS sets_pct, tp.partner_id
FROM (SELECT DISTINCT player_id FROM fx_match_players) p
LEFT JOIN (SELECT player_id, count(*) AS total, count(*) FILTER (is_winner = 1) AS wins, count(*) FILTER (is_winner <> 1) AS losses
           FROM fx_appearances GROUP BY 1) t USING (player_id)
LEFT JOIN (SELECT player_id, count(*) AS finals, count(*) FILTER (is_winner = 1) AS titles FROM fx_appearances WHERE round = 'Final' GROUP BY 1) f USING (player_id)
LEFT JOIN ({STREAK}) s USING (player_id) LEFT JOIN ({FORM}) fo USING (player_id) LEFT JOIN ({SETS_GAMES}) g USING (player_id)
LEFT JOIN (SELECT player_id, partner_id, row_number() OVER (PARTITION BY player_id ORDER BY played DESC, won DESC, partner_id) AS rn
           FROM ({_PARTNERS})) tp ON tp.player_id = p.player_id AND tp.rn = 1""", (AP, MP))
def player_profile(fx):
    return h.profile(fx.match_players, fx.matches).select(
        "player_id", "total", "wins", "losses", "titles", "finals", "streak", "streak_type", "form", "sets_won", "games_won",
        F.col("sets_pct").cast("string").alias("sets_pct"), "partner_id",
    )


@query("player_search", """
SELECT p.id, p.name, p.country, count(*) AS matches, p.name ILIKE '0%' AS prefix
FROM fx_players p JOIN fx_match_players mp ON mp.player_id = p.id WHERE p.name ILIKE '%00%'
GROUP BY ALL ORDER BY prefix DESC, matches DESC, p.id LIMIT 25""", ("fx_players", MP))
def player_search(fx):
    return h.search(fx.players, fx.match_players, "00").withColumn("prefix", F.col("name").ilike("0%"))


@query("resolve_names", """
SELECT q.name, CASE WHEN n_exact = 1 THEN exact_id WHEN n_hit = 1 THEN hit_id END::VARCHAR AS id,
  CASE WHEN n_exact = 1 THEN 'exact' WHEN n_hit = 1 THEN 'hit' WHEN n_hit > 1 THEN 'ambiguous' ELSE 'none' END AS outcome
FROM (SELECT DISTINCT name FROM (
        SELECT lower(s_name) AS name FROM supplier UNION ALL
        SELECT right(s_name, 5) FROM supplier UNION ALL
        SELECT right(c_name, 4) FROM customer)) q
LEFT JOIN (
  SELECT q2.name, count(*) AS n_hit, min(p.id) AS hit_id, count(*) FILTER (lower(p.name) = lower(q2.name)) AS n_exact,
    min(p.id) FILTER (lower(p.name) = lower(q2.name)) AS exact_id
  FROM (SELECT DISTINCT name FROM (SELECT lower(s_name) AS name FROM supplier UNION ALL SELECT right(s_name, 5) FROM supplier
        UNION ALL SELECT right(c_name, 4) FROM customer)) q2
  JOIN fx_players p ON contains(lower(p.name), lower(q2.name)) GROUP BY 1) hits ON hits.name = q.name""", ("fx_players",))
def resolve_names(fx):
    s, c = fx.table("supplier"), fx.table("customer")
    names = s.select(F.lower("s_name").alias("name")).unionByName(s.select(F.right("s_name", F.lit(5)).alias("name"))).unionByName(
        c.select(F.right("c_name", F.lit(4)).alias("name"))
    )
    return h.resolve_names(names, fx.players).withColumn("id", F.col("id").cast("string"))


@query("tournament_chips", """
SELECT player_id, t.name AS tournament, count(*) AS n FROM fx_appearances a JOIN fx_tournaments t ON t.tkey = a.tkey GROUP BY 1, 2""", (AP, T))
def tournament_chips(fx):
    return h.tournament_choice(h.match_list(fx.match_players, fx.matches, fx.tournaments), [])[1]


@query("tournament_multi_select", """
SELECT player_id, match_id, t.name AS tournament FROM fx_appearances a JOIN fx_tournaments t ON t.tkey = a.tkey
WHERE t.name IN ('Customer#000000001', 'Customer#000000007')""", (AP, T))
def tournament_multi_select(fx):
    mine = h.match_list(fx.match_players, fx.matches, fx.tournaments)
    return h.tournament_choice(mine, ["Customer#000000001", "Customer#000000007"])[0].select("player_id", "match_id", "tournament")


@query("regroup_sides", """
SELECT match_id, CAST(side AS INT) AS side, string_agg('P' || player_id, ' / ' ORDER BY pos) AS team, max(is_winner) = 1 AS won
FROM fx_match_players GROUP BY 1, 2""", (MP,))
def regroup_sides(fx):
    mp = fx.match_players.withColumn("name", F.concat(F.lit("P"), F.col("player_id").cast("string")))
    return h.regroup_sides(mp).select("match_id", "side", "team", "won")


@query("flatten_players", """
SELECT f.id AS match_id, CAST(v.i // 2 + 1 AS INT) AS side, CAST(v.i % 2 + 1 AS INT) AS pos, [p0, p1, p2, p3][v.i + 1] AS name,
  CASE WHEN status = 'final' AND k % 2 = v.i // 2 THEN 1 ELSE 0 END AS is_winner
FROM fx_feed f CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i)""", ("fx_feed",))
def flatten_players(fx):
    return h.flatten_players(fx.feed).select("match_id", "side", "pos", "name", "is_winner")
