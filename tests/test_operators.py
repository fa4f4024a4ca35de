"""Operators against step-by-step computations on small or skewed inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from check import oracle_connection
from courtside.functions import lookups as lk
from courtside.functions.text import fold, is_round_report
from courtside.operators import alerts as al, archive as ar, contains as ct, feed as fd, filters as fl, history as h, linkage as ln, ordered as od, schedule as sch
from courtside.plans import ORACLES
from courtside.plans.fixtures import Fixtures, today
from courtside.plans.linkage import part_draws
from courtside.sources import landed, pages, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF)


def test_running_over_a_hot_key_in_slices(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rnd.randint(-5, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = od.running(df, ["k"], ["o"], od.ordinal_slice(F.col("o"), 37), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    seen, want = {}, {}
    for k, o, v in rows:
        seen.setdefault(k, []).append(v)
        want[o] = (sum(seen[k]), max(seen[k]))
    assert {r["o"]: (r["s"], r["m"]) for r in got.collect()} == want


def test_last_known_before_each_row(spark):
    rows = [("a", i, i if i % 4 == 0 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = od.last_known(df, ["k"], ["o"], od.ordinal_slice(F.col("o"), 6), F.col("v"), "p", inclusive=False)
    want = {i: (((i - 1) // 4) * 4 if i else None) for i in range(50)}
    assert {r["o"]: r["p"] for r in got.collect()} == want


def test_court_chain_equals_sequential_fold(spark):
    rnd = random.Random(7)
    rows = []
    for court in range(12):
        now = rnd.choice([None, 700])
        for i in range(rnd.randint(1, 9)):
            rows.append(("t", 1, f"c{court}", court * 100 + i, rnd.choice([None, "9:00 AM"]), rnd.choice([None, "Not before 3:00 PM", "Followed by", "2:00 PM"]),
                         rnd.choice(["final", "live", "upcoming", "upcoming"]), rnd.choice([None, 0, 60, 120]), now))
    df = spark.createDataFrame(rows, "tournament string, day int, court string, ordinal int, court_start string, schedule string, status string, dur int, now_min int")
    clock = {"Not before 3:00 PM": 900, "2:00 PM": 840, "9:00 AM": 540}
    want, running = {}, {}
    for t, d, c, o, start, sched, status, dur, now in rows:
        if c not in running:
            running[c] = next(x for x in (clock.get(start), clock.get(sched), now, 540) if x is not None)
        r = running[c]
        if status == "final":
            running[c] = r + (dur or 85) + 10
        elif status == "live":
            running[c] = (now if now is not None else r) + max(12, 85 - (dur or 42.5)) + 10
        else:
            est = max(r, now) if now is not None else r
            if sched == "Not before 3:00 PM":
                est = max(est, 900)
            want[o] = est
            running[c] = est + 95
    got = {r["ordinal"]: r["est_min"] for r in sch.estimate_starts(df, width=3).collect() if r["est_min"] is not None}
    assert got == want


def test_contains_pairs_equals_nested_loop(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    needles, hay = [word(rnd.randint(1, 5)) for _ in range(30)], [word(rnd.randint(0, 9)) for _ in range(40)]
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame([(x,) for x in hay], "hay string")
    got = {(r["needle"], r["hay"]) for r in ct.contains_pairs(n, t).collect()}
    assert got == {(a, b) for a in needles for b in hay if a in b}


def test_merge_feeds_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("a", "live", 0, 1), ("b", "live", 0, 2), ("a", "final", 1, 9)], "id string, status string, source_rank int, ordinal int")
    got = {r["id"]: (r["status"], tuple(r["first_seen"])) for r in fd.merge_feeds(df).collect()}
    assert got == {"a": ("final", (0, 1)), "b": ("live", (0, 2))}
    again = fd.merge_feeds(fd.merge_feeds(df).select("id", "status", F.col("first_seen.source_rank"), F.col("first_seen.ordinal")))
    assert {r["id"]: r["status"] for r in again.collect()} == {"a": "final", "b": "live"}


def test_streak_with_nulls_and_losses(spark):
    m = spark.createDataFrame([(i, f"2020-01-0{i}") for i in range(1, 6)], "id int, d string").select("id", F.to_date("d").alias("match_date"))
    mp = spark.createDataFrame(
        [(i, 1, 1, "w", 1) for i in range(1, 6)] + [(1, 2, 1, "l", 1)] + [(i, 2, 1, "l", 0) for i in range(2, 6)] + [(5, 2, 2, "n", None), (4, 2, 2, "n", None), (3, 2, 2, "n", 0)],
        "match_id int, side int, pos int, player_id string, is_winner int")
    got = {r["player_id"]: (r["streak"], r["streak_type"]) for r in h.streak(mp, m).collect()}
    assert got == {"w": (5, "W"), "l": (4, "L"), "n": (2, "L")}


def test_head_to_head_is_symmetric(fx):
    flipped = fx.match_players.withColumn("player_id", -F.col("player_id"))
    one = {(r["a"], r["b"]): r for r in h.head_to_head(fx.match_players, fx.matches).collect()}
    two = {(-r["b"], -r["a"]): r for r in h.head_to_head(flipped, fx.matches).collect()}
    assert {k: (v["a_wins"], v["b_wins"], v["together"]) for k, v in one.items()} == {k: (v["b_wins"], v["a_wins"], v["together"]) for k, v in two.items()}


def test_eras_cover_every_year_once(fx):
    years = {(r["gender"], r["year"]) for r in fx.no1.collect()}
    spans = [(e["gender"], y) for e in ar.eras(fx.no1).collect() for y in range(e["from_year"], e["to_year"] + 1)]
    assert len(spans) == len(years) and set(spans) == years


def test_day_strip_has_no_gap(fx):
    days = sorted(r["day"] for r in fd.day_strip(fx.feed, today()).collect())
    assert (days[-1] - days[0]).days + 1 == len(days) and len(days) <= lk.LOOKBACK_DAYS + lk.LOOKAHEAD_DAYS + 1


def test_bracket_with_a_bye_and_open_slot(spark):
    rows = [("g", "s1", "Semifinal", 1, ["A", "B"]), ("g", "s2", "Semifinal", 2, ["C", "D"]), ("g", "s3", "Semifinal", 3, ["E", "F"]), ("g", "f", "Final", 4, ["A", "Z"])]
    df = spark.createDataFrame(rows, "g string, id string, round string, ordinal int, names array<string>").select(
        F.col("g").alias("group"), "id", "round", "ordinal", F.transform("names", lambda n: F.struct(n.alias("name"))).alias("teams"))
    got = {(r["parent_id"], r["child_id"], r["kind"], r["team"]) for r in ar.bracket_edges(df, project=True).collect()}
    assert got == {("f", "s1", "match", "A"), ("f", None, "bye", "Z"), (None, "s2", "tbd", None), (None, "s3", "tbd", None)}


def greedy(edges):
    """Pairs of (-score, draw place, tournament place, path, key) edges, best first, each end once."""
    took_p, took_t, out = set(), set(), set()
    for _, _, _, p, t in sorted(edges):
        if p not in took_p and t not in took_t:
            took_p.add(p), took_t.add(t), out.add((p, t))
    return out


def test_draw_assignment_equals_greedy_over_all_pairs(fx):
    d, t = part_draws(fx), fx.archive_names
    pairs, free = ln.assign_draws(d, t)
    got = {(r["path"], r["key"]) for r in pairs.collect()}
    scores = oracle_connection(SF).execute(ORACLES["score_draws"].replace(" AND c + v + w > 0", "")).fetchall()   # month-only edges too
    path, place = {r["ordinal"]: r["path"] for r in d.collect()}, {r["key"]: r["ordinal"] for r in t.collect()}
    assert got == greedy([(-score, d_ord, place[key], path[d_ord], key) for d_ord, key, score in scores])
    assert len({p for p, _ in got}) == len({k for _, k in got}) == len(got)
    assert free.count() == d.count() - len(got)


def test_articles_are_found_by_the_rarest_piece_of_a_city(spark):
    """Short names, names inside words, accents, repeated ids and a city that no text holds, against a loop over all pairs."""
    rnd = random.Random(5)
    towns = ["Ávila", "Y", "Nu", "Lima", "San Juan", "anan", "Zzz", None, " "]
    t = [(f"t{i}", rnd.choice(towns), f"2015-03-{rnd.randint(1, 28):02d}" if i % 9 else None) for i in range(40)]
    words = ["avila", "AVILA", "x", "y", "nu", "numa", "lima", "Limas", "san", "juan", "San Juan", "banana", "6-4", "2/6", "final"]
    a = [(rnd.randrange(90), f"2015-03-{rnd.randint(1, 28):02d}", rnd.choice(["finale", "master", "x"]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for _ in range(120)]
    tdf = spark.createDataFrame(t, "key string, city string, s string").select("key", "city", F.to_date("s").alias("start"))
    adf = spark.createDataFrame(a, "article_id long, d string, title string, text string").select("article_id", F.to_date("d").alias("date"), "title", "text")
    reports = {(r["article_id"], str(r["date"]), r["hay"]) for r in adf.where(is_round_report(F.col("title"), F.col("text"), F.lit(""))).select("article_id", "date", fold(F.concat_ws(" ", "title", "text")).alias("hay")).collect()}
    cities = {(r["key"], str(r["start"]), r["k"]) for r in tdf.where("start is not null and trim(city) <> ''").select("key", "start", fold("city").alias("k")).collect()}
    want = {(k, i) for k, start, city in cities for i, date, hay in reports if city in hay and -8 <= int(date[8:]) - int(start[8:]) <= 18}
    found = ln.discover_articles(tdf, adf)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50
    assert ln.discover_articles(tdf.limit(0), adf).count() == 0 and ln.discover_articles(tdf, adf.limit(0)).count() == 0


def test_assignment_rounds_write_no_more_than_the_edges(spark, monkeypatch):
    """A chain, where each pair taken frees the next one, a hot tournament that many draws want, and random edges."""
    rnd = random.Random(3)
    chain = [(f"c{i}", f"k{j}", i, j, 100.0 - i - j) for i in range(30) for j in (i, i + 1)]
    hot = [(f"h{i}", "hot", 100 + i, 100, 5.0) for i in range(60)]
    mixed = [(f"r{rnd.randrange(40)}", f"s{rnd.randrange(40)}", 0, 0, float(rnd.randrange(4))) for _ in range(300)]
    mixed = [(p, k, 200 + int(p[1:]), 200 + int(k[1:]), s) for (p, k), s in {(p, k): s for p, k, _, _, s in mixed}.items()]
    tables_, rows = [], chain + hot + mixed
    make = ln.rounds
    monkeypatch.setattr(ln, "rounds", lambda *a: tables_.append(make(*a)) or tables_[-1])
    edges = spark.createDataFrame(rows, "path string, key string, d_ord int, t_ord int, score double")
    got = ln.assign_one_to_one(edges)
    assert {(r["path"], r["key"]) for r in got.collect()} == greedy([(-s, i, j, p, k) for p, k, i, j, s in rows])
    edge_rows, by_path, by_key, won = (t.rows().count() for t in tables_)
    assert edge_rows == len(rows) and by_path <= len(rows) and by_key <= len(rows) and won == got.count()
    assert ln.assign_one_to_one(edges.limit(0)).collect() == []


def test_month_alone_assigns_in_order_beside_shifting_edges(spark):
    rnd = random.Random(11)
    t, d = [], []
    for i in range(40):
        month = rnd.choice([2, 3])
        t.append((f"t{i}", i, 2015, rnd.choice(["Lima", "Oslo", None, None, None]), f"n{i}", f"2015-{month:02d}-{rnd.randint(2, 27):02d}" if rnd.random() < 0.8 else None))
        d.append((f"/wpt/2015/{rnd.choice(['febrero', 'marzo', 'x'])}/{rnd.choice(['oslo', 'zz', 'yy'])}{'' if rnd.random() < .5 else i}/", i, 2015, f"m{i}"))
    d = list({p[0]: p for p in d}.values())
    tdf = spark.createDataFrame(t, "key string, ordinal int, year int, city string, name string, s string").withColumn("start", F.to_date("s"))
    ddf = spark.createDataFrame(d, "path string, ordinal int, year int, name string")
    got = {(r["path"], r["key"]) for r in ln.assign_draws(ddf, tdf)[0].collect()}
    points = {("febrero", 2): 3, ("marzo", 3): 3, ("febrero", 3): 1, ("marzo", 2): 1}
    edges = []
    for path, i, _, _ in d:
        month, city = path.split("/")[3:5]
        for key, j, _, town, _, start in t:
            score = 3 * (town == "Oslo" and city.startswith("oslo")) + (points.get((month, int(start[5:7])), 0) if start else 0)
            if score >= 3:
                edges.append((-score, i, j, path, key))
    assert got == greedy(edges)


def test_reconcile_reads_rows_in_order(spark):
    finals = spark.createDataFrame(
        [("k", "Men", ["Ana Garcia Bea Lopez"], ["Run One", "Run Two"], None, None)],
        "key string, gender string, winners array<string>, runners_up array<string>, winner_ids array<string>, runner_ids array<string>").select(
        "*", F.lit("s").alias("score"), F.lit("wiki").alias("source"))
    w = ["Ana Garcia", "Bea Lopez"]
    rows = [(1, ["Zoe Smith", "Eva Jones"], ["9"]), (2, w, []), (3, list(reversed(w)), ["1", "2"]), (4, w, ["3"]), (5, ["Zoe Smith", "Eva Jones"], [])]
    linked = spark.createDataFrame(rows, "row_id int, winners array<string>, winner_ids array<string>").select(
        "row_id", F.col("row_id").alias("ordinal"), F.lit("k").alias("key"), F.lit("Men").alias("gender"), "winners", F.array(F.lit("Run One"), F.lit("Run Two")).alias("runners_up"),
        F.lit("x").alias("score"), "winner_ids", F.array().cast("array<string>").alias("runner_ids"))
    updated, outcomes = ln.reconcile(linked, finals)
    assert {r["row_id"]: r["outcome"] for r in outcomes.collect()} == {1: "conflict", 2: "repaired", 3: "ids added", 4: "already complete", 5: "conflict"}
    row = updated.first()
    assert row["winners"] == w and row["winner_ids"] == ["1", "2"] and row["score"] == "s"


def test_draw_results_need_one_side_to_advance(spark):
    def name(r, c, p):
        return ("d", "Men", r, c, f"{p}a {p}b", [f"{p}a", f"{p}b"], True)

    head = [("d", "Men", 0, c, t, [t], False) for c, t in enumerate(["Cuartos", "Semi", "Final"])]
    cells = head + [name(1, 0, "P"), name(3, 0, "Q"), name(5, 0, "R"), name(7, 0, "S"), name(2, 1, "Q"), name(6, 1, "R"), name(8, 1, "S"),
                    ("d", "Men", 3, 1, "6/4 6/4", ["6/4 6/4"], False), ("d", "Men", 4, 1, "mie 6/4", ["x"], False)]
    df = spark.createDataFrame(cells, "path string, gender string, r int, c int, text string, lines array<string>, is_name boolean")
    got = [(r["round"], r["winners"], r["losers"], r["score"]) for r in ln.draw_results(ln.classify_cells(df)).collect()]
    assert got == [("Quarterfinal", ["Qa", "Qb"], ["Pa", "Pb"], "6-4 6-4")]


def test_page_cells_lay_out_row_spans():
    td = lambda t, extra="": f'<td {extra}>{t}</td>'
    pair = lambda p: td(f"{p} Uno<br/>{p} Dos", 'class="primera" bgcolor="#000000"')
    rows = ["<tr>" + td("Cuartos") + td("Semi") + td("Final") + "</tr>", "<tr>" + td("x", 'rowspan="2"') + pair("A") + "</tr>", "<tr>" + pair("B") + "</tr>"]
    rows += ["<tr>" + td("", 'colspan="2"') + pair(p) + "</tr>" for p in "CDEFGH"]
    got = {(r, c): text for r, c, text, _, is_name in pages.page_cells("<table><tr><td><table>" + "".join(rows) + "</table></td></tr></table>") if is_name}
    assert got[(1, 1)] == "A Uno A Dos" and got[(2, 1)] == "B Uno B Dos" and got[(3, 2)] == "C Uno C Dos"


def test_part_files_skip_corrupt_ones(spark, tmp_path):
    (tmp_path / "part-1.json").write_text('[{"key": "a", "gender": "Men", "round": "Final", "winners": ["x", "y"], "losers": ["z", "w"], "score": "6-4"}]')
    (tmp_path / "part-2.json").write_text('[{"key": "b", ')
    good, bad = landed.read_parts(spark, str(tmp_path / "part-*.json"))
    assert [r["key"] for r in good.collect()] == ["a"] and bad.count() == 1


def test_guard_refuses_thin_output(spark, tmp_path):
    with pytest.raises(tables.GuardFailed):
        tables.guarded_overwrite(spark.range(3), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_gate_refuses_low_agreement(spark):
    v = spark.createDataFrame([("pass",)] * 2 + [("fail",)] * 2, "verdict string")
    with pytest.raises(tables.GuardFailed):
        ln.require_gate(v)
    ln.require_gate(v.where("verdict = 'pass'"))


def test_health_levels(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    ts = lambda t: f"timestamp_ntz'2024-01-01 {t}'"
    feed = spark.sql(f"select {ts('11:30:00')} generated_at, 5L total, 2 rankings")
    status = lambda ok, last: spark.sql(f"select 'fip' source, {ok} ok, 3 match_count, 'x' error, {last} last_ok_at")
    verdict = lambda s, f=feed: al.health(s, f, now)[1].first()["overall"]
    assert verdict(status("true", ts("11:30:00"))) == "ok"
    assert verdict(status("false", ts("10:00:00"))) == "warn"
    assert verdict(status("false", ts("08:00:00"))) == "down"
    assert verdict(status("false", "cast(null as timestamp_ntz)")) == "warn"
    assert verdict(status("true", ts("11:30:00")), feed.where("false")) == "down"
    assert verdict(status("true", ts("11:30:00")), spark.sql(f"select {ts('10:30:00')} generated_at, 5L total, 2 rankings")) == "down"


def test_follows_with_broken_json(spark):
    subs = spark.createDataFrame([("e1", '{"players":{"1":{"name":"Ana Sol"}}}'), ("e2", "{oops"), ("e3", None), ("e4", '{"tournaments":{"fip:7":{"name":"T"}}}')], "endpoint string, follows string")
    got = {(r["endpoint"], r["kind"], r["key"]) for r in al.follow_rows(subs).collect()}
    assert got == {("e1", "player", "1"), ("e4", "tournament", "fip:7")}


def test_trailing_days_stop_at_the_first_gap(spark):
    df = spark.createDataFrame([("a", d, n) for d, n in enumerate([0, 2, 1, 3, 0, 5], 1)] + [("b", 1, 0)], "event_id string, day int, matches int")
    assert {(r["event_id"], r["day"]) for r in sch.trailing_days(df).collect()} == {("a", 3), ("a", 4)}


def test_filters_reach_the_scan(fx):
    plan = fl.covers_day(fx.table("orders").select(F.col("o_orderdate").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"), "o_orderkey"), today())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in text.split("ReadSchema")[1]


def test_top_k_is_cut_before_the_shuffle(fx):
    plan = h.form(fx.match_players, fx.matches)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stamps_count_wherever_they_stand_and_with_their_offset(spark):
    late = '{"pad": "' + "x" * 900 + '", "generatedAt": "2026-01-02T09:00:00Z"}'
    rows = [("a", "d1", '{"generatedAt": "2026-01-02T12:00:00+05:00"}'), ("a", "static", late)]
    copies = spark.createDataFrame(rows, "key string, origin string, body string").withColumn("stamp", tables.body_stamp(F.col("body")))
    assert tables.freshest(copies).first()["origin"] == "static"


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from courtside.session import local_folder

    with pytest.raises(RuntimeError):
        local_folder(SimpleNamespace(master="spark://host:7077"), "x-")


def bracket(pairs: int, heads: list[str], extra: str = "") -> str:
    """A bracket page of one column of pairs under a header row."""
    head = "<tr>" + "".join(f"<td><b>{h}</b></td>" for h in heads) + "</tr>"
    rows = "".join(f'<tr><td bgcolor="#000000" class="primera"><table><tr><td>Ana {i}</td></tr><tr><td>Bea {i}</td></tr></table></td></tr>' for i in range(pairs))
    return f"<table>{head}{rows}{extra}</table>"


def test_page_cells_drop_tables_without_pairs_but_keep_those_of_a_pair():
    page = bracket(8, ["Cuartos", "Semifinales", "Final"], "<tr><th>x</th><td>6/4 6/2<table><tr><td>advert</td></tr></table></td></tr>")
    cells = {(r, c): (text, lines) for r, c, text, lines, _ in pages.page_cells(page)}
    assert cells[(1, 0)] == ("Ana 0 Bea 0", ["Ana 0", "Bea 0"])
    assert cells[(9, 0)] == ("6/4 6/2", ["6/4 6/2"])            # no advert, and the th takes no column


def test_page_cells_count_each_round_once():
    qualifying = bracket(9, ["1ª ronda", "2ª ronda", "3ª ronda"])
    main = bracket(8, ["1/4", "Cuartos", "Semifinales", "Final"])
    found = pages.page_cells(f"<div>{qualifying}</div><div>{main}</div>")
    assert {text for _, _, text, _, name in found if not name} == {"1/4", "Cuartos", "Semifinales", "Final"}
    assert sum(name for *_, name in found) == 8


def test_freshest_prefers_a_readable_stamp_of_one_origin(spark):
    rows = [("k", "d1", "good", "2024-05-01T09:00:00Z"), ("k", "d1", "bad", "yesterday"), ("z", "d1", "late", "2024-05-01T09:00:00Z"), ("z", "static", "early", "2024-05-01T12:00:00+05:00")]
    got = {r["key"]: r["body"] for r in tables.freshest(spark.createDataFrame(rows, "key string, origin string, body string, stamp string")).collect()}
    assert got == {"k": "good", "z": "late"}


def folded(spine, other, days=4):
    """Row after row, as a reader would: targets of the foreign rows in reading order, and the starts that are known at the end."""
    events = {k: start for k, start in spine}
    targets = []
    for key, start in other:
        at = key if key in events else next((k for k, v in events.items() if start and v and abs((v - start).days) <= days), None)
        targets.append(at)
        if at is not None and events[at] is None:
            events[at] = start
    return targets, events


@pytest.mark.parametrize("seed", range(4))
def test_season_merge_reads_in_order(spark, seed):
    rng = random.Random(seed)
    when = lambda: rng.choice([None, dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(25))])
    spine = [(f"s{k}", when()) for k in range(12)]
    other = [(rng.choice([f"s{rng.randrange(12)}", f"x{k}"]), when()) for k in range(60)]
    shape = "key string, season int, ordinal long, name string, city string, country string, start date, finals map<string, struct<winners: array<string>, runners_up: array<string>, score: string, sets: array<string>>>"
    rows = lambda side: spark.createDataFrame([(k, 2020, i, k, None, None, d, {}) for i, (k, d) in enumerate(side)], shape)
    facts, _, unmatched = ln.merge_seasons(rows(spine), rows(other))
    targets, events = folded(spine, other)
    assert {r["key"]: r["start"] for r in facts.collect()} == events
    assert sorted(r["ordinal"] for r in unmatched.collect()) == [i for i, t in enumerate(targets) if t is None]


def test_merges_aggregate_no_whole_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1, "H", ["x"], ["y"], ["6-4"], "wide")], "id string, event_id int, source_rank int, ordinal int, header string, players_a array<string>, players_b array<string>, sets array<string>, body string")
    for df in (fd.merge_feeds(rows), fd.best_variant(rows), fd.distinct_first(rows, ["id"]), tables.latest_by_key(rows, ["id"], ["ordinal"]), od.best_row(rows, ["id"], [F.col("ordinal")])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        grouped = [line for line in plan.splitlines() if "Aggregate" in line]
        assert plan.count("WindowGroupLimit") >= 2 and not any("body" in line for line in grouped), plan


def test_merge_feeds_odd_rows(spark):
    shape = "id string, status string, source_rank int, ordinal int"
    rows = spark.createDataFrame([(None, "x", 0, 1), (None, "y", 1, 0), ("a", None, 0, 2), ("a", None, 0, 2)], shape)
    got = {r["id"]: (r["status"], tuple(r["first_seen"])) for r in fd.merge_feeds(rows).collect()}
    assert got == {None: ("y", (0, 1)), "a": (None, (0, 2))}
    assert fd.merge_feeds(rows.where("false")).count() == 0


def test_teams_of_odd_matches(spark):
    mp = spark.createDataFrame(
        [(1, 1, 2, 5, "B", 0), (1, 1, 1, 4, "A", 0), (1, 2, None, 6, "C", 1), (2, 2, 1, 7, None, None), (3, 9, 1, 8, "D", 0)],
        "match_id int, side int, pos int, player_id int, name string, is_winner int")
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (1,)], "match_id int")
    got = sorted(((r["match_id"] or 0), r["team_1"], r["team_2"]) for r in h.with_teams(rows, mp).collect())
    assert got == [(0, "TBD", "TBD"), (1, "A / B", "C"), (1, "A / B", "C"), (2, "TBD", "TBD"), (3, "D", "TBD"), (4, "TBD", "TBD")]
    assert h.with_teams(rows.where("false"), mp).count() == 0


def test_pair_match_list_cut_and_uncut(fx):
    mp = fx.match_players.withColumn("name", F.col("player_id").cast("string"))
    take = lambda k: {(r["a"], r["b"], r["opponents"], r["rn"], r["match_id"], r["team_1"]) for r in h.pair_match_list(mp, fx.matches, fx.tournaments, k).collect()}
    assert take(3) == {row for row in take(None) if row[3] <= 3}
