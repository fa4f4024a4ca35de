"""Match history: profiles, partners, head-to-head, search.

Tables: players(id, name, country), tournaments(tkey, name, federation),
matches(id, tkey, match_date, class, round, score, winner_side, …),
match_players(match_id, side, pos, player_id, is_winner).
Every operator answers for all players at once; a caller filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions.labels import is_final_round
from courtside.functions.scores import games, percent
from courtside.operators.ordered import best_row, first_rows


def appearances(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per player and match with the match columns."""
    m = matches.withColumnRenamed("id", "match_id")
    return mp.join(m, "match_id")


def match_list(mp: DataFrame, matches: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Appearances with the tournament's name and federation."""
    t = tournaments.select("tkey", F.col("name").alias("tournament"), "federation")
    return appearances(mp, matches).join(t, "tkey")


def recent_matches(mp: DataFrame, matches: DataFrame, tournaments: DataFrame, k: int = 60) -> DataFrame:
    """The k latest matches per player, newest first; cut before the tournament join."""
    top = first_rows(
        appearances(mp, matches), ["player_id"], [F.col("match_date").desc_nulls_last(), F.col("match_id").desc()], k
    )
    t = tournaments.select("tkey", F.col("name").alias("tournament"), "federation")
    return top.join(t, "tkey")


def by_year(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches played and won per player and year; undated matches do not count."""
    dated = appearances(mp, matches).where("match_date is not null")
    return dated.groupBy("player_id", F.year("match_date").alias("yr")).agg(
        F.count("*").alias("played"), F.count_if(F.col("is_winner") == 1).alias("won")
    )


def totals(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Career totals over dated matches."""
    return by_year(mp, matches).groupBy("player_id").agg(
        F.sum("played").alias("total"), F.sum("won").alias("wins"),
        (F.sum("played") - F.sum("won")).alias("losses"),
    )


def titles(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Finals reached and won per player."""
    finals = appearances(mp, matches.where(is_final_round(F.col("round"))))
    return finals.groupBy("player_id").agg(
        F.count("*").alias("finals"), F.count_if(F.col("is_winner") == 1).alias("titles")
    )


def sets_games(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Sets and games won and lost per player from the score texts.

    The text is read once per match; both sides take their numbers from that.
    """
    parts = F.filter(
        F.transform(F.split(F.trim("score"), r"\s+"), lambda s: F.split(s, "-")), lambda p: F.size(p) == 2
    )
    sets = F.transform(parts, lambda p: F.struct(games(p[0]).alias("a"), games(p[1]).alias("b")))
    total = lambda f: F.aggregate("sets", F.lit(0), lambda acc, s: acc + f(s))
    per_match = matches.where("score <> ''").select(F.col("id").alias("match_id"), sets.alias("sets")).select(
        "match_id",
        total(lambda s: (s["a"] > s["b"]).cast("int")).alias("s1"),
        total(lambda s: (s["b"] > s["a"]).cast("int")).alias("s2"),
        total(lambda s: s["a"]).alias("g1"), total(lambda s: s["b"]).alias("g2"),
    )
    first = F.col("side") == 1
    mine = lambda a, b: F.sum(F.when(first, F.col(a)).otherwise(F.col(b)))
    out = mp.select("match_id", "player_id", "side").join(per_match, "match_id").groupBy("player_id").agg(
        mine("s1", "s2").alias("sets_won"), mine("s2", "s1").alias("sets_lost"),
        mine("g1", "g2").alias("games_won"), mine("g2", "g1").alias("games_lost"),
    )
    return out.withColumn("sets_pct", percent(F.col("sets_won"), F.col("sets_lost"))).withColumn(
        "games_pct", percent(F.col("games_won"), F.col("games_lost"))
    )


def _one_side(mp: DataFrame) -> DataFrame:
    """Each player once per match, on the side of the first position listed."""
    return (
        mp.where("player_id is not null").repartition("match_id").groupBy("match_id", "player_id")
        .agg(F.min_by("side", F.struct("side", "pos")).alias("side"), F.max("is_winner").alias("is_winner"))
    )


def partners(mp: DataFrame) -> DataFrame:
    """Record of every player with every partner: played, won."""
    one = _one_side(mp)
    other = one.select("match_id", "side", F.col("player_id").alias("partner_id"))
    pairs = one.join(other, ["match_id", "side"]).where("player_id <> partner_id")
    return pairs.groupBy("player_id", "partner_id").agg(
        F.count("*").alias("played"), F.count_if(F.col("is_winner") == 1).alias("won")
    )


def top_partner(mp: DataFrame) -> DataFrame:
    """Most frequent partner; ties by wins, then by the smaller id."""
    return best_row(partners(mp), ["player_id"], [F.col("played"), F.col("won"), -F.col("partner_id")])


def pair_matches(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per match and pair of its players (a < b), as opponents or partners."""
    one = _one_side(mp)
    a = one.select("match_id", F.col("player_id").alias("a"), F.col("side").alias("side_a"))
    b = one.select("match_id", F.col("player_id").alias("b"), F.col("side").alias("side_b"))
    m = matches.select(F.col("id").alias("match_id"), "winner_side", "match_date")
    return a.join(b, "match_id").where("a < b").join(m, "match_id").withColumn(
        "opponents", F.col("side_a") != F.col("side_b")
    )


def head_to_head(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Tally of every pair of players that ever met or played together."""
    won = lambda side: F.col("winner_side") == F.col(side)
    opp = F.col("opponents")
    return pair_matches(mp, matches).groupBy("a", "b").agg(
        F.count_if(opp).alias("opponents"),
        F.count_if(opp & won("side_a")).alias("a_wins"),
        F.count_if(opp & won("side_b")).alias("b_wins"),
        F.count_if(~opp).alias("together"),
        F.count_if(~opp & won("side_a")).alias("together_wins"),
    )


def pair_match_list(mp: DataFrame, matches: DataFrame, tournaments: DataFrame, k: int | None = None) -> DataFrame:
    """Matches of every pair of players, as opponents or partners, newest first (`rn`), with both teams.

    `result`: whether a's side won (opponents) or both did (partners); null without a winner. A report may ask for the
    first k of each pair and kind; uncut otherwise.
    """
    detail = matches.select(F.col("id").alias("match_id"), "tkey", "class", "round", "score")
    pairs = pair_matches(mp, matches)
    result = lambda rows: rows.withColumn("result", F.col("winner_side") == F.col("side_a"))
    newest = [F.col("match_date").desc_nulls_last(), F.col("match_id").desc()]
    t = tournaments.select("tkey", F.col("name").alias("tournament"), "federation")
    if k is None:
        # a match meets its tournament before it is repeated for its pairs; ranks count matches without one too
        named = t.groupBy("tkey").agg(F.collect_list(F.struct("tournament", "federation")).alias("_t"))
        of_match = pairs.join(detail.join(named, "tkey", "left"), "match_id")
        listed = first_rows(with_teams(result(of_match), mp), ["a", "b", "opponents"], newest, None)
        return listed.select("*", F.explode("_t").alias("_at")).select("*", "_at.*").drop("_t", "_at")
    pairs = result(pairs.join(detail, "match_id"))
    return with_teams(first_rows(pairs, ["a", "b", "opponents"], newest, k), mp).join(t, "tkey")


def shared_matches(mp: DataFrame, a: Column, b: Column, k: int | None = None) -> DataFrame:
    """Matches both players took part in; a list report may ask for the first k ids."""
    ids = lambda p: mp.where(F.col("player_id") == p).select("match_id")
    both = ids(a).intersect(ids(b))
    return both if k is None else both.orderBy("match_id").limit(k)


def _class(win: Column) -> Column:
    return F.coalesce(win.cast("int"), F.lit(-1))


def form(mp: DataFrame, matches: DataFrame, k: int = 12) -> DataFrame:
    """Last k results as text, newest first; anything not won is an L."""
    top = first_rows(
        appearances(mp, matches), ["player_id"], [F.col("match_date").desc_nulls_last(), F.col("match_id").desc()], k
    )
    mark = F.when(F.col("is_winner") == 1, "W").otherwise("L")
    listed = F.sort_array(F.collect_list(F.struct("rn", mark.alias("w"))))
    return top.groupBy("player_id").agg(F.concat_ws("", F.transform(listed, lambda s: s["w"])).alias("form"))


def streak(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Length and type of the current run of equal results.

    Per player the newest position of each result decides which result is current and
    where the run began; the run is then counted. Both steps are aggregations, so a
    player with very many matches needs no sorted window.
    """
    no_date = F.lit("0001-01-01").cast("date")
    rows = appearances(mp, matches).select(
        "player_id", _class(F.col("is_winner")).alias("res"),
        F.struct(F.coalesce(F.col("match_date"), no_date).alias("d"), "match_id").alias("at"),
    )
    newest = lambda r: F.max(F.when(F.col("res") == r, F.col("at")))
    ends = rows.groupBy("player_id").agg(
        F.max_by("res", "at").alias("current"), newest(1).alias("w"), newest(0).alias("l"), newest(-1).alias("u")
    )
    before = F.greatest(
        *[F.when(F.col("current") != r, F.col(c)) for r, c in ((1, "w"), (0, "l"), (-1, "u"))]
    )
    ends = ends.select("player_id", "current", before.alias("broken_at"))
    run = rows.join(ends, "player_id").where("broken_at is null or at > broken_at")
    return run.groupBy("player_id").agg(
        F.count("*").alias("streak"), F.when(F.max("current") == 1, "W").otherwise("L").alias("streak_type")
    )


def profile(mp: DataFrame, matches: DataFrame) -> DataFrame:
    """Summary per player: totals, titles, streak, form, sets and games, top partner."""
    everyone = mp.where("player_id is not null").select("player_id").distinct()
    top = top_partner(mp).select("player_id", "partner_id", F.col("played").alias("partner_matches"), F.col("won").alias("partner_wins"))
    out = everyone
    for part in (
        totals(mp, matches), titles(mp, matches), streak(mp, matches), form(mp, matches), sets_games(mp, matches), top,
    ):
        out = out.join(part, "player_id", "left")
    zero = ["total", "wins", "losses", "titles", "finals", "sets_won", "sets_lost", "games_won", "games_lost"]
    return out.fillna(0, zero)


def search(players: DataFrame, mp: DataFrame, q: str, k: int = 25, least: int = 2) -> DataFrame:
    """Players whose name contains q with their number of matches; prefix hits first.

    A text of fewer than `least` characters finds nobody; 0 answers every text.
    """
    q = q.strip()
    hits = players.where(F.col("name").ilike(f"%{q}%")) if len(q) >= least else players.limit(0)
    counts = mp.join(hits.select(F.col("id").alias("player_id")), "player_id", "left_semi").groupBy("player_id").agg(
        F.count("*").alias("matches")
    )
    return (
        hits.join(counts.withColumnRenamed("player_id", "id"), "id")
        .withColumn("prefix", F.col("name").ilike(f"{q}%"))
        .orderBy(F.col("prefix").desc(), F.col("matches").desc(), "id").limit(k)
    )


def resolve_names(names: DataFrame, players: DataFrame) -> DataFrame:
    """name → id by a unique equal name, else a unique hit; outcome exact / hit / ambiguous / none.

    A hit is a player whose name contains the text, as the search offers it.
    """
    from courtside.operators.contains import contains_pairs

    asked = names.select("name").distinct().withColumn("q", F.lower(F.trim("name"))).where("q <> ''")
    known = players.select("id", F.lower("name").alias("hay"))
    hits = contains_pairs(asked.select(F.col("q").alias("needle")), known.select("hay"))
    found = hits.join(known, "hay").groupBy(F.col("needle").alias("q")).agg(
        F.count("*").alias("n_hit"), F.min("id").alias("hit_id"),
        F.count_if(F.col("hay") == F.col("needle")).alias("n_exact"),
        F.min(F.when(F.col("hay") == F.col("needle"), F.col("id"))).alias("exact_id"),
    )
    exact, hit = F.col("n_exact") == 1, F.col("n_hit") == 1
    return asked.join(found, "q", "left").select(
        "name",
        F.when(exact, F.col("exact_id")).when(hit, F.col("hit_id")).alias("id"),
        F.when(exact, "exact").when(hit, "hit").when(F.col("n_hit") > 1, "ambiguous").otherwise("none").alias("outcome"),
    )


def tournament_choice(mine: DataFrame, selected: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matches of the selected tournaments, chips): nothing selected means all."""
    label = F.coalesce(F.col("tournament"), F.lit("—"))
    shown = mine.where(label.isin(selected)) if selected else mine
    chips = mine.groupBy("player_id", label.alias("tournament")).agg(F.count("*").alias("n"))
    return shown, chips


def regroup_sides(mp: DataFrame) -> DataFrame:
    """Two sides per match from player rows: names by position, won if any winner.

    A side outside 1 and 2 counts as side 1. A match lists a handful of players.
    """
    rows = mp.groupBy("match_id", _side().alias("side")).agg(
        F.sort_array(F.collect_list(_player())).alias("ps"),
        F.max(F.coalesce(F.col("is_winner"), F.lit(0)) == 1).alias("won"),
    )
    return rows.select(
        "match_id", "side", team_text("ps").alias("team"), F.transform("ps", lambda p: p["player_id"]).alias("players"), "won"
    )


def _side() -> Column:
    return F.when(F.col("side") == 2, 2).otherwise(1)


def _player() -> Column:
    return F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "player_id", "name")


def team_text(players: str) -> Column:
    """Names of a side by position; TBD if it has none."""
    names = F.concat_ws(" / ", F.transform(players, lambda p: p["name"]))
    return F.coalesce(F.nullif(names, F.lit("")), F.lit("TBD"))


def with_teams(rows: DataFrame, mp: DataFrame) -> DataFrame:
    """Rows of matches (match_id) with the teams of both sides, team_1 and team_2; TBD where a match has no players.

    One aggregation by match, so rows that are dealt by match already are not shuffled again. Rows without a match stay.
    """
    on = lambda side: F.sort_array(F.collect_list(F.when(_side() == side, _player())))
    teams = mp.groupBy("match_id").agg(on(1).alias("_p1"), on(2).alias("_p2"))
    teams = teams.select("match_id", team_text("_p1").alias("team_1"), team_text("_p2").alias("team_2"))
    out = rows.join(teams, "match_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("TBD")) for c in ("team_1", "team_2")})


def flatten_players(m: DataFrame) -> DataFrame:
    """Player rows (match_id, side, pos, name, country, is_winner) of nested matches."""
    sides = m.select(F.col("id").alias("match_id"), F.col("score.winner").alias("w"), F.posexplode("teams").alias("s", "t"))
    return sides.select("match_id", "w", "s", F.posexplode("t.players").alias("p", "pl")).select(
        "match_id", (F.col("s") + 1).alias("side"), (F.col("p") + 1).alias("pos"), "pl.name", "pl.country",
        F.coalesce((F.col("w") == F.col("s")).cast("int"), F.lit(0)).alias("is_winner"),
    )
