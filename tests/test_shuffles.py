"""Work that is done once: shuffles of draws and of pair lists, words of a name."""

import re

from courtside.functions.text import same_pair
from courtside.operators import history as h, linkage as ln
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def draw(spark, twice=False):
    """A draw of four pairs with a header, and one whose header names two rounds only."""
    name = lambda p, r, c, n: (p, "Men", r, c, f"{n}a {n}b", [f"{n}a", f"{n}b"], True)
    text = lambda p, r, c, t: (p, "Men", r, c, t, [t], False)
    rows = [text("d", 0, c, t) for c, t in enumerate(["Cuartos", "Semi", "Final"])] + [text("e", 0, c, t) for c, t in enumerate(["Semi", "Final"])]
    for p in ("d", "e", None):
        rows += [name(p, 1, 0, "P"), name(p, 3, 0, "Q"), name(p, 5, 0, "R"), name(p, 7, 0, "S"), name(p, 2, 1, "Q"), name(p, 6, 1, "R"), name(p, 4, 2, "R")]
        rows += [text(p, 3, 1, "6/4 6/4"), text(p, 7, 1, "6/1 6/1"), text(p, 5, 2, "7/5 7/5"), text(p, 1, 2, "Anything else")]
    return spark.createDataFrame(rows * (2 if twice else 1), "path string, gender string, r int, c int, text string, lines array<string>, is_name boolean")


def test_a_draw_is_shuffled_once_and_read_once(spark):
    df = ln.draw_results(ln.classify_cells(draw(spark)))
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bScan\b", text)) == 1
    got = {(r["path"], r["round"], r["c"], r["match_no"], r["winners"][0], r["losers"][0], r["score"]) for r in df.collect()}
    assert got == {("d", "Quarterfinal", 0, 0, "Qa", "Pa", "6-4 6-4"), ("d", "Quarterfinal", 0, 1, "Ra", "Sa", "6-1 6-1"),
                   ("d", "Semifinal", 1, 0, "Ra", "Qa", "6-4 6-4")}


def test_header_cells_listed_twice_repeat_the_cells_below(spark):
    kinds = ln.classify_cells(draw(spark, twice=True)).groupBy("path", "c").count().collect()
    assert {(r["path"], r["c"]): r["count"] for r in kinds} == {("d", 0): 16, ("d", 1): 16, ("d", 2): 8}
    assert ln.draw_results(ln.classify_cells(draw(spark, twice=True))).isEmpty()


def test_words_of_a_name_are_taken_once(spark):
    df = spark.createDataFrame([(["Ana Lopez", "Bea Ruiz"], ["Beatriz Ruiz", "Lopez, A."])], "p array<string>, q array<string>")
    pair = df.select(same_pair(F.col("p"), F.col("q")).alias("v"))
    assert pair.first()["v"] and plan(pair).count("lower(") == 4


def test_matches_meet_their_tournament_before_they_are_repeated_for_pairs(spark):
    mp = spark.createDataFrame([(m, 1 + i // 2, 1 + i % 2, p, f"P{p}", 0) for m in (1, 2, 3) for i, p in enumerate((1, 2, 3, 4))],
                               "match_id long, side int, pos int, player_id long, name string, is_winner int")
    matches = spark.createDataFrame([(1, 7, "2020-01-01"), (2, 8, "2020-01-02"), (3, None, "2020-01-03")], "id long, tkey long, day string").select(
        "id", "tkey", F.col("day").cast("date").alias("match_date"), F.lit("Men").alias("class"), F.lit("Final").alias("round"),
        F.lit("6-4").alias("score"), F.lit(1).alias("winner_side"))
    tournaments = spark.createDataFrame([(7, "Seven", "X"), (8, "Eight", "Y"), (8, "Eight again", "Z")], "tkey long, name string, federation string")
    df = h.pair_match_list(mp, matches, tournaments)
    # the rank of the match without a tournament stays; a tournament listed twice gives two rows of one rank
    got = sorted((r["rn"], r["match_id"], r["tournament"]) for r in df.where("a = 1 and b = 2").collect())
    assert got == [(2, 2, "Eight"), (2, 2, "Eight again"), (3, 1, "Seven")] and df.count() == 18
    above = plan(df).split("Window")[0]
    assert "Join" not in above and "Exchange" not in above


def test_plain_texts_are_cleaned_and_folded_as_others(spark):
    from courtside.functions.text import clean, fold

    texts = [None, "", "  a  b ", "a\tb", "\na b\r", "a\x0b\x0cb", "a b", "é  b", " a b ", "Á Ñ", "Ana B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(clean(F.col("t")).alias("c"), fold(F.col("t")).alias("f"))
    assert [r["c"] for r in df.collect()] == ["", "", "a b", "a b", "a b", "a b", "a b", "é b", "a b", "Á Ñ", "Ana B"]
    assert [r["f"] for r in df.collect()][-2:] == ["a n", "ana b"]
