"""Heavy surnames, teams and tournaments in follow matching; lists and digests of subscribers."""

import glob

from pyspark.sql import functions as F

from courtside.operators import alerts as al
from courtside.operators.skew import grid_join, heavy_keys

FEED = ("id string, ordinal int, status string, federation string, source string, round string, court string, est_start string,"
        "tournament struct<id:string,name:string>, teams array<struct<name:string>>")


def match(i, names, status="upcoming", tid=None, est=None):
    return (f"m{i}", i, status, "FIP", "fip", "Final", f"C{i}", est, (tid or f"t{i}", "Cup"), [(n,) for n in names])


def pairs(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_grid_join_is_the_join(spark):
    keys = F.when(F.col("x") % 3 == 0, "hot").when(F.col("x") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("x") % 11).cast("string")))
    a = spark.range(90).select(F.col("id").alias("x")).select("x", keys.alias("key"))
    b = spark.range(60).select(F.col("id").alias("x")).select(keys.alias("key"), F.col("x").alias("y"))
    want = pairs(a.join(b, "key").select("key", "x", "y"))
    assert pairs(grid_join(a, b, "key", "x", "y", cell=4).select("key", "x", "y")) == want
    assert pairs(grid_join(a, b, "key", "x", cell=4).select("key", "x", "y")) == want
    assert pairs(grid_join(a, b, "key", "x", "y").select("key", "x", "y")) == want
    assert grid_join(a, b.where("false"), "key", "x", "y", cell=4).isEmpty()


def test_heavy_keys_are_few_and_cut_to_size(spark):
    a = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 40).alias("key"))
    heavy = {r["key"]: (r["_na"], r["_nb"]) for r in heavy_keys(a, None, "key", 50, 100).collect()}
    assert heavy == {-1: (6, 1)}
    some = heavy_keys(a, a, "key", 1, 7)                   # every key has more than one row; seven may be listed, so 258 is heavy
    assert some.count() <= 7 and some.where("key = -1").count() == 1


def test_a_surname_in_a_third_of_all_matches(spark, monkeypatch):
    """Spread over a grid or not, the hits are those of a loop over all followers and matches."""
    names = lambda i: [f"Ana Star{i if i % 3 else ''} / B{i}", f"Eva X{i} / Y"]
    m = [match(i, names(i), ["live", "upcoming", "final"][i % 3], "big" if i % 2 else None) for i in range(60)]
    follows = [(f"e{k}", "player", str(k), "Ana  STAR") for k in range(30)] + [(f"e{k}", "tournament", "fip:big", "T") for k in range(20, 40)]
    follows += [("e90", "player", "1", "Eva X7"), ("e91", "player", "2", "Jo Y"), ("e92", "player", "3", None), ("e92", "tournament", None, None)]
    want = set()
    for e, kind, key, name in follows:
        last = (name or "").lower().split()[-1:] or [""]
        for i, *_, t, teams in m:
            if (kind == "tournament" and key == f"fip:{t[0]}") or (kind == "player" and len(last[0]) >= 2 and any(last[0] in n.lower() for n, in teams)):
                want.add((e, int(i[1:]), i))
    frames = lambda: (spark.createDataFrame(m, FEED), spark.createDataFrame(follows, "endpoint string, kind string, key string, name string"))
    assert set(map(tuple, al.match_follows(*frames(), least=2).collect())) == want
    monkeypatch.setattr(al, "grid_join", lambda *x: grid_join(*x, cell=5))
    assert set(map(tuple, al.match_follows(*frames(), least=2).collect())) == want
    status = {r[0]: r[2] for r in m}
    got = al.followed_open(*frames(), shown=3).where("endpoint = 'e25'").orderBy("rn").collect()
    mine = sorted((status[i] != "live", o, i) for e, o, i in want if e == "e25" and status[i] != "final")
    assert [(r["rn"], r["id"]) for r in got] == [(n + 1, i) for n, (_, _, i) in enumerate(mine[:3])]


def test_soon_digest_tells_the_estimate(spark):
    m = spark.createDataFrame([match(1, ["A / B", "C / D"], est="15:30"), match(2, ["E", "F"], est="")], FEED).withColumn("g", F.lit(1))
    text = al.digest(m, "starting soon", ["g"], listed=1, kind="soon").first()["text"]
    assert text == "starting soon (2)\n\nFIP International (~15:30): A / B  vs  C / D\nC1 · Final · Cup\n\n…and 1 more"
    assert "(soon): E  vs  F" in al.digest(m, "starting soon", ["g"], kind="soon").first()["text"]


def test_hits_of_many_follows_are_made_once(spark, monkeypatch):
    """Surnames inside one another, several of one endpoint in one match, two tournaments, equal teams, long follow lists."""
    m = [match(i, [f"Ana Star{i % 4}", f"Eva Starling{i % 3}"], ["live", "upcoming"][i % 2], ["big", "small"][i % 5 == 0]) for i in range(40)]
    m.append(m[7])                                                    # a match delivered twice
    names = {"e1": ["A Star", "B Starling", "C star1"], "e2": ["Z Starling2", "A Star3"], "e3": ["X none"], "e4": ["A Star2"], "e5": []}
    tours = {"e1": ["fip:big"], "e2": ["fip:small", "fip:big"], "e3": ["fip:small"], "e4": [], "e5": ["fip:big", "fip:none"]}
    follows = [(e, "player", n, n) for e in names for n in names[e]] + [(e, "tournament", t, "T") for e in tours for t in tours[e]]
    want = {(e, i, k) for e in names for k, i, *_, t, teams in m if f"fip:{t[0]}" in tours[e]
            or any(n.lower().split()[-1] in x[0].lower() for n in names[e] for x in teams)}
    frames = lambda: (spark.createDataFrame(m, FEED), spark.createDataFrame(follows, "endpoint string, kind string, key string, name string"))
    status = {r[0]: r[2] for r in m}
    once, make = [], al._Follows.__init__
    for most in (200, 2):
        monkeypatch.setattr(al._Follows, "__init__", lambda s, a, b, c, most=most: make(s, a, b, c, most))
        found = al.match_follows(*frames())
        rows = [tuple(r) for r in found.collect()]
        assert sorted(rows) == sorted(want)
        once.append(found._jdf.queryExecution().optimizedPlan().toString().lstrip().split()[0])
        n = {r["endpoint"]: r["n"] for r in al.notifications(*frames(), listed=2).collect()}
        assert n == {e: sum(x[0] == e for x in want) for e in names if any(x[0] == e for x in want)}
        got = al.followed_open(*frames(), shown=4).where("endpoint = 'e2'").orderBy("rn").collect()
        mine = sorted((status[k] != "live", i, k) for e, i, k in want if e == "e2" for _ in range(1 + (k == "m7")))
        assert [r["id"] for r in got] == [k for _, _, k in mine[:4]]
    assert once[0].startswith("Union")                                # nothing above the joins makes the hits distinct


def few_follows():
    """A match told twice with two statuses, one without a place, one without an id; endpoints of one, two, many and no names, one without an id."""
    m = [match(i, [f"Ana Star{i % 4}", f"Eva Moon{i % 3}"], ["live", "upcoming", "final"][i % 5 % 3], ["big", "small"][i % 6 == 0]) for i in range(40)]
    m += [m[7], ("m8", 8, "live", *m[8][3:]), ("m9", 99, *m[9][2:]), ("m50", None, "live", *m[1][3:]), (None, 3, "live", *m[1][3:]), ("m51", 51, None, *m[1][3:])]
    names = {"e1": ["A Star"], "e2": ["B Star1"], None: ["C Star1"], "e3": ["D Moon2", "E Star"], "e4": ["X none"], "e5": [], "e6": ["A Star1", "B Moon", "C Star2", "D Star3"], "e7": ["B Star1"]}
    tours = {"e1": [], "e2": ["fip:small"], None: ["fip:small"], "e3": ["fip:big"], "e4": ["fip:small"], "e5": ["fip:big"], "e6": ["fip:small", "fip:big"], "e7": []}
    follows = [(e, "player", n, n) for e in names for n in names[e]] + [(e, "tournament", t, "T") for e in tours for t in tours[e]]
    groups, want = {(o, k): (t[0], [n.lower() for n, in teams]) for k, o, s, *_, t, teams in m if k and s in ("live", "upcoming")}, set()
    for e in names:
        mine = [(o, k) for (o, k), (t, teams) in groups.items() if f"fip:{t}" in tours[e] or any(n.lower().split()[-1] in x for n in names[e] for x in teams)]
        rows = sorted((s != "live", -1 if o is None else o, k, s) for o, k in mine for k2, _, s, *_ in m if k2 == k and s in ("live", "upcoming"))
        want |= {(e, n + 1, k, s) for n, (*_, k, s) in enumerate(rows)}
    return m, follows, want


def test_lists_are_whole_however_they_are_put_in_order(spark, monkeypatch):
    m, follows, want = few_follows()
    frames = spark.createDataFrame(m, FEED), spark.createDataFrame(follows, "endpoint string, kind string, key string, name string")
    make, rank = al._Follows.__init__, al._Follows.ranked
    for most, extra in ((200, 32), (200, 3), (4, 0)):
        monkeypatch.setattr(al._Follows, "__init__", lambda s, a, b, c, most=most: make(s, a, b, c, most))
        monkeypatch.setattr(al._Follows, "ranked", lambda s, order, extra=extra: rank(s, order, extra))
        rows = [tuple(r) for r in al.followed_open(*frames).collect()]
        # endpoints of many follows are joined by place and id: there a match without a place is none
        gone = {k for k in want if most == 4 and k[0] == "e6"}
        assert len(rows) == len(set(rows)) and set(rows) - {r for r in rows if most == 4 and r[0] == "e6"} == want - gone


def test_a_surname_is_put_in_order_once_for_all_who_follow_it(spark):
    """Sorted by endpoint, the hits of all followers went through one shuffle."""
    m, follows, _ = few_follows()
    frames = spark.createDataFrame(m, FEED), spark.createDataFrame([f for f in follows if f[0] in ("e1", "e7")], "endpoint string, kind string, key string, name string")
    df = al.followed_open(*frames)
    assert df.count() > 0
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(needle" in text and "windowspecdefinition(endpoint" not in text


def test_matches_are_stored_with_their_surnames(spark):
    """Line-ups are searched and forgotten; only matches with the surnames in them stay on disk and are joined."""
    m, follows, _ = few_follows()
    f = al._Follows(spark.createDataFrame(m, FEED), spark.createDataFrame(follows, "endpoint string, kind string, key string, name string"), 3)
    assert f.matches.columns == ["ordinal", "id", "keys", "needles"]
    assert "lineup" not in f.hits()._jdf.queryExecution().optimizedPlan().toString()
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not glob.glob(f"{folder}/told-once-*") and glob.glob(f"{folder}/followed-*")
