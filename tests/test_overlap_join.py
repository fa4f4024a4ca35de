"""The prefix-filter join of word sets and the links that rest on it, against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import linkage as ln
from courtside.operators.overlap_join import overlap_pairs

WORDS = [f"w{i}" for i in range(12)] + ["the"] * 6                       # one word is in most sets


def some_sets(seed, n):
    r = random.Random(seed)
    return [(r.choice("xy"), sorted({r.choice(WORDS) for _ in range(r.randint(0, 7))}, key=lambda w: r.random())) for _ in range(n)]


def share(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


@pytest.mark.parametrize("at_least", [-0.5, 1 / 3, 2 / 3, 0.75, 1.0, 1.2])
def test_pairs_are_those_of_a_loop(spark, at_least):
    a, b = some_sets(1, 40), some_sets(2, 50)
    frame = lambda rows: spark.createDataFrame(rows, "g string, words array<string>")
    got = overlap_pairs(frame(a), frame(b), ["g"], at_least).collect()
    want = {(g, " ".join(x), " ".join(z)): share(x, z) for g, x in a for h, z in b if g == h and share(x, z) >= max(at_least - 1e-9, 1e-9)}
    assert len(got) == len(want) and {(r["g"], r["lk"], r["rk"]): pytest.approx(r["share"]) for r in got} == want
    assert overlap_pairs(frame(a), frame(b[:0]), ["g"], at_least).isEmpty()


def test_finals_link_as_a_loop_links_them(spark):
    """Long names, so that a pair may share few words; dates near, far and missing; cities inside one another."""
    r = random.Random(5)
    word = lambda: r.choice(["madrid", "open", "spring", "grand", "night", "coast", "tower", "river", "stone", "field", "bridge"])
    name = lambda: " ".join(word() for _ in range(r.randint(1, 7)))
    city = lambda: r.choice(["", "Lugo", "Lugo Norte", "Vigo", None])
    date = lambda: r.choice([None, *[f"2020-0{m}-{d:02d}" for m in (1, 2) for d in (1, 8, 15, 22)]])
    rows = [(i, 2020, city(), name(), date()) for i in range(40)]
    ts = [(f"k{i}", i, 2020, city(), name(), date()) for i in range(40)]
    day = F.col("d").cast("date")
    left = spark.createDataFrame(rows, "row_id int, year int, city string, name string, d string").withColumn("final_date", day).drop("d")
    right = spark.createDataFrame(ts, "key string, ordinal int, year int, city string, name string, d string").withColumn("start", day).drop("d")
    got = {x["row_id"]: (x["key"], x["score"]) for x in ln.link_finals(left, right).collect()}
    from datetime import date as D

    from courtside.functions.lookups import STOP_FINALS

    words = lambda t: {w for w in t.split() if len(w) >= 3 and w not in STOP_FINALS}
    want = {}
    for i, _, c, n, d in rows:
        best = None
        for k, o, _, tc, tn, td in ts:
            a, b = (c or "").lower(), (tc or "").lower()
            score = 3.0 if a and b and (a in b or b in a) else 0.0
            score += 3 * share(words(n), words(tn))
            if d and td and (gap := abs((D.fromisoformat(d) - D.fromisoformat(td)).days)) <= 10:
                score += 1.5 - gap / 10
            if score >= 2.5 and (best is None or score > best[1] + 1e-9):
                best = (k, score)
        if best:
            want[i] = (best[0], round(best[1], 6))
    assert got == want
