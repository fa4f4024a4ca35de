"""Sources, sinks, normalisers and exports over tables derived from the given ones."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from courtside.operators import history as h, normalise as nm
from courtside.plans.fixtures import pick, today
from courtside.plans.registry import cte, query
from courtside.plans.streams import work
from courtside.sources import archive as ar, export as ex, landed as ld, pages as pg, tables as tb

d = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
s = lambda c: c.cast("string")
long = lambda c: F.col(c).cast("long").alias(c)
join_sets = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.concat_ws("-", x["a"], x["b"])))
FEED = ("fx_feed",)


def write_json(fx, df, name: str) -> str:
    path = os.path.join(work(fx), name)
    df.write.json(path)
    return path


# --- archive files ---------------------------------------------------------------------------
def archive_docs(fx):
    """One JSON document per tournament, written and scanned back."""
    m = fx.feed.select(
        F.col("tournament.id").alias("tid"), "ordinal", F.col("federation"), F.col("tournament.name").alias("name"),
        F.struct(
            F.col("class_name").alias("className"), "round", "court", "status", "teams",
            F.struct(F.transform("score.sets", lambda x: F.array(x["a"], x["b"])).alias("sets"), F.col("score.winner").alias("winner")).alias("score"),
        ).alias("m"),
    )
    docs = m.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("ordinal", "m"))).alias("ms"), F.min("name").alias("name")).select(
        F.concat(F.lit("rin-"), F.col("tid")).alias("key"), "name", F.lit("SE").alias("federation"), F.lit("2020-01-01").alias("start"),
        F.lit("2020-01-02").alias("end"), F.lit("rin").alias("source"), F.transform("ms", lambda x: x["m"]).alias("matches"),
    )
    path = write_json(fx, docs, "archive")
    return ar.read_archive(fx.spark, path, multi_line=False)


@query("archive_scan_tournaments", "SELECT 'rin-' || tid AS key, min(tname) AS name, count(*) AS n, '2020-01-01' AS start FROM fx_feed GROUP BY 1", FEED)
def archive_scan_tournaments(fx):
    return ar.archive_tournaments(archive_docs(fx)).select("key", "name", long("n"), d("start"))


@query("archive_scan_matches", """
SELECT 'rin-' || tid AS key, row_number() OVER (PARTITION BY tid ORDER BY k) - 1 AS ordinal, class_name, round, p0 || ' / ' || p1 AS team_a,
  CASE status WHEN 'final' THEN '6-' || (k % 5) || ' 6-' || ((k + 2) % 5) WHEN 'live' THEN (k % 7) || '-' || (k % 5) ELSE '' END AS sets FROM fx_feed""", FEED)
def archive_scan_matches(fx):
    m = ar.archive_matches(archive_docs(fx))
    return m.select("key", long("ordinal"), "class_name", "round", F.col("teams")[0]["name"].alias("team_a"), join_sets("score.sets").alias("sets"))


# --- landed payloads and normalisers ------------------------------------------------------------
def api_raw(fx):
    k = F.col("ordinal")
    name = lambda t, i: F.col("teams")[t]["players"][i]["name"]
    side = lambda t: F.struct(
        F.when(k % 19 != 0, name(t, 0)).alias("Name"), F.lit("es").alias("CountryShort"), F.when(k % 4 != 0, name(t, 1)).alias("Player2Name"), F.lit("").alias("Player2CountryShort")
    )
    played = F.col("status") == "final"
    detail = F.transform("score.sets", lambda x: F.struct(x["a"].alias("FirstParticipantScore"), x["b"].alias("SecondParticipantScore")))
    m = F.struct(
        s(k).alias("Id"), F.col("class_name").alias("TournamentClassName"), F.col("round").alias("Draw"), F.col("court").alias("Court"),
        F.when(k % 3 == 0, "0001-01-01T00:00:00").when(k % 3 == 1, F.lit("2020-05-05T10:00:00")).alias("Date"), F.lit(6).alias("State"),
        side(0).alias("Challenger"), side(1).alias("Challenged"),
        F.struct(played.alias("IsPlayed"), F.struct(F.when(k % 7 != 0, k % 2 == 0).alias("IsFirstParticipantWinner"), detail.alias("DetailedScoring")).alias("Score")).alias("MatchResult"),
    )
    payloads = fx.feed.groupBy(F.col("tournament.id").alias("event_id")).agg(F.sort_array(F.collect_list(F.struct("ordinal", m.alias("m")))).alias("ms")).select(
        "event_id", F.transform("ms", lambda x: x["m"]).alias("Matches")
    )
    path = write_json(fx, payloads, "payloads")
    return ld.api_matches(ld.read_api_payloads(fx.spark, path, multi_line=False))


def api_events(fx):
    ck = F.col("c_custkey")
    return fx.table("customer").select(
        s(ck).alias("event_id"), F.col("c_name").alias("event_name"), F.concat(F.lit("/e/"), s(ck)).alias("event_url"), F.lit("DK").alias("federation"),
        F.when(ck % 2 == 0, "Hall").alias("club"), F.when(ck % 3 == 0, "Road 1").alias("address"), F.lit("Town").alias("city"), F.lit("Liga").alias("ranking"),
        F.lit("2020-05-01T00:00:00").alias("start_date"), F.lit("2020-05-03T00:00:00").alias("end_date"),
        nm.organiser(ck % 2 == 0, F.when(ck % 4 == 0, " Club "), F.lit("/c")).alias("organiser"),
    )


def _team(a, b):
    return f"CASE WHEN k % 19 = 0 AND k % 4 = 0 THEN 'TBD' WHEN k % 19 = 0 THEN {b} WHEN k % 4 = 0 THEN {a} ELSE {a} || ' / ' || {b} END"


@query("normalise_api", f"""
SELECT 'rankedin:' || k AS id, CASE WHEN ck % 2 = 0 THEN 'Hall' END AS venue, CASE WHEN ck % 3 = 0 THEN 'Road 1' ELSE 'Town' END AS address,
  CASE WHEN ck % 4 = 0 THEN 'Club' END AS organizer, '2020-05-01' AS start, status, CASE WHEN k % 3 = 1 THEN '2020-05-05T10:00:00' ELSE '2020-05-01T00:00:00' END AS start_time,
  {_team('p0', 'p1')} AS team_a, {_team('p2', 'p3')} AS team_b,
  CASE WHEN status = 'final' AND k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END ELSE '-' END AS winner,
  CASE status WHEN 'final' THEN '6-' || (k % 5) || ' 6-' || ((k + 2) % 5) WHEN 'live' THEN (k % 7) || '-' || (k % 5) ELSE '' END AS sets FROM fx_feed""", FEED)
def normalise_api(fx):
    m = nm.normalise_api(api_raw(fx), api_events(fx), "rankedin", "https://example.org")
    return m.select(
        "id", "tournament.venue", "tournament.address", "tournament.organizer", F.date_format("tournament.start", "yyyy-MM-dd").alias("start"), "status", "start_time",
        F.col("teams")[0]["name"].alias("team_a"), F.col("teams")[1]["name"].alias("team_b"),
        F.coalesce(pick(F.col("score.winner"), "a", "b"), F.lit("-")).alias("winner"), join_sets("score.sets").alias("sets"),
    )


@query("normalise_widget", """
SELECT 'fip:E' || ck || ':' || replace(p0 || '+' || p1 || '|' || p2 || '+' || p3 || '|' || round, ' ', '') AS id, 'A & B' AS title,
  CASE WHEN k % 5 = 0 THEN 'final' WHEN status = 'final' THEN 'final' WHEN status = 'live' THEN 'live' ELSE 'upcoming' END AS status,
  CASE WHEN status = 'final' THEN CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END ELSE '-' END AS winner,
  CASE WHEN status = 'upcoming' THEN '' ELSE '6-' || (k % 5) END AS sets FROM fx_feed""", FEED)
def normalise_widget(fx):
    k = F.col("ordinal")
    names = lambda t: F.transform(F.col("teams")[t]["players"], lambda p: F.concat(F.lit(" "), p["name"]))
    up, done = F.col("status") == "upcoming", F.col("status") == "final"
    raw = fx.feed.select(
        "ordinal", F.concat(F.lit("E"), F.col("tournament.id")).alias("event_id"), F.lit("A &amp; B").alias("title"), F.lit("/x").alias("link"), "round", "court", "schedule",
        "est_start", F.lit(None).alias("est_start_at"), F.lit(1).alias("day_n"), F.lit("JUL 16 THU").alias("day_label"),
        F.when(k % 5 == 0, "completed").otherwise("").alias("summary_status"), (done & (k % 2 == 0)).alias("won_a"), (done & (k % 2 == 1)).alias("won_b"),
        F.when(up, F.array(F.lit("-"), F.lit(""))).otherwise(F.array(F.lit("6"), F.lit("-"))).alias("cells_a"),
        F.when(up, F.array(F.lit("-"))).otherwise(F.array(s(k % 5), F.lit(""))).alias("cells_b"),
        names(0).alias("players_a"), names(1).alias("players_b"), F.array(F.lit("ESP"), F.lit("ARG")).alias("countries_a"), F.array(F.lit("ESP"), F.lit("ARG")).alias("countries_b"),
    )
    m = nm.normalise_widget(raw)
    return m.select("id", F.col("tournament.name").alias("title"), "status", F.coalesce(pick(F.col("score.winner"), "a", "b"), F.lit("-")).alias("winner"), join_sets("score.sets").alias("sets"))


@query("widget_summary", """
SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'completed' WHEN k % 3 = 1 THEN 'live' ELSE '' END AS status, CASE WHEN k % 3 = 2 THEN NULL ELSE '01:' || (10 + k % 40) END AS duration FROM fx_feed""", FEED)
def widget_summary(fx):
    k = F.col("ordinal")
    text = F.concat(F.when(k % 3 == 2, "soon").otherwise(F.concat(F.lit("01:"), s(10 + k % 40))), F.when(k % 3 == 0, " Completed").otherwise(""))
    w = nm.widget_summary(text)
    return fx.feed.select(k.alias("id"), w["status"].alias("status"), w["duration"].alias("duration"))


@query("normalise_rows", """
SELECT 'ts:G' || ck || ':' || replace('XP' || k || '[1]+Y(C)|Z|HerrerRunde2|' || CASE WHEN status = 'upcoming' THEN '[]' ELSE '[{"a":"6","b":"' || (k % 5) || '"}]' END, ' ', '') AS id,
  'Herrer' AS class_name, 'Runde 2' AS round, status, '2020-05-0' || (k % 9 + 1) || 'T' || CASE WHEN k % 2 = 0 THEN '10:30' ELSE '00:00' END || ':00' AS start_time, 'X P' || k || ' / Y' AS team_a FROM fx_feed""", FEED)
def normalise_rows(fx):
    k = F.col("ordinal")
    done = F.col("status") == "final"
    sets = F.when(F.col("status") == "upcoming", F.array().cast("array<struct<a:string,b:string>>")).otherwise(F.array(F.struct(F.lit("6").alias("a"), s(k % 5).alias("b"))))
    raw = fx.feed.select(
        "ordinal", F.concat(F.lit("G"), F.col("tournament.id")).alias("event_id"), F.lit("T").alias("title"), F.lit("/l").alias("link"), F.lit("NO").alias("federation"),
        F.lit("Herrer Runde 2").alias("header"), F.concat(F.lit("2020-05-0"), s(k % 9 + 1)).cast("date").alias("date"), F.when(k % 2 == 0, "10:30").alias("time"),
        F.array(F.concat(F.lit("X P"), s(k), F.lit(" [1]")), F.lit("Y (C)")).alias("players_a"), F.array(F.lit("Z")).alias("players_b"),
        sets.alias("sets"), (done & (k % 2 == 0)).alias("won_a"), (done & (k % 2 == 1)).alias("won_b"),
    )
    m = nm.normalise_rows(raw)
    return m.select("id", "class_name", "round", "status", "start_time", F.col("teams")[0]["name"].alias("team_a"))


def broken_feed(fx):
    k = F.col("ordinal")
    return fx.feed.withColumn("id", F.when(k % 101 != 0, F.col("id"))).withColumn("status", F.when(k % 103 == 0, "paused").otherwise(F.col("status"))).withColumn(
        "teams", F.when(k % 107 == 0, F.slice("teams", 1, 1)).otherwise(F.col("teams")))


_REASON = "CASE WHEN k % 101 = 0 THEN 'missing id' WHEN k % 103 = 0 THEN 'bad status' WHEN k % 107 = 0 THEN 'not two teams' END"


@query("validated_matches", f"SELECT k AS ordinal FROM fx_feed WHERE {_REASON} IS NULL", FEED)
def validated(fx):
    return nm.validate(broken_feed(fx))[0].select("ordinal")


@query("quarantined_matches", f"SELECT k AS ordinal, {_REASON} AS reason FROM fx_feed WHERE {_REASON} IS NOT NULL", FEED)
def quarantined(fx):
    return nm.validate(broken_feed(fx))[1].select("ordinal", "reason")


@query("source_verdicts", f"SELECT source, count(*) AS rows, count(*) FILTER ({_REASON} IS NOT NULL) AS bad, bool_and({_REASON} IS NULL) AS ok FROM fx_feed GROUP BY 1", FEED)
def source_verdicts(fx):
    return nm.source_verdicts(broken_feed(fx))


@query("organiser_pairs", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN 'Club /c' END AS organiser FROM customer")
def organiser_pairs(fx):
    ck = F.col("c_custkey")
    o = nm.organiser(F.when(ck % 7 != 0, ck % 2 == 0).otherwise(ck % 2 == 0), F.when(ck % 3 != 0, " Club ").otherwise(" "), F.when(ck % 5 != 0, "/c"))
    return fx.table("customer").select(ck.alias("id"), F.concat_ws(" ", o["name"], o["url"]).alias("t")).select(
        "id", F.nullif("t", F.lit("")).alias("organiser"))


# --- files of lists ------------------------------------------------------------------------------
def list_files(fx, rows, key, name: str) -> str:
    """A file for 25 keys, each a JSON list; every fifth is cut short, every seventh is an object."""
    page = F.floor(key / 25)
    text = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), rows.alias("r")))), lambda x: x["r"]))
    files = fx.table("customer").groupBy(page.alias("page")).agg(text.alias("t"))
    bad = F.when(F.col("page") % 5 == 3, F.expr("substring(t, 1, length(t) - 9)")).when(F.col("page") % 7 == 4, F.lit('{"error": "none"}'))
    path = os.path.join(work(fx), name)
    files.select("page", F.coalesce(bad, "t").alias("value")).repartition("page").write.partitionBy("page").text(path)
    return path


_PAGE = "(c_custkey // 25)"
_GOOD_PAGE = f"{_PAGE} % 5 <> 3 AND {_PAGE} % 7 <> 4"
page_of = lambda: F.regexp_extract("file", r"page=(\d+)", 1).cast("long").alias("page")


@query("final_rows", f"""
SELECT {_PAGE} AS page, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS tournament, 'Score ' || c_custkey AS score, CASE WHEN c_custkey % 4 <> 0 THEN 'P' || c_custkey END AS winner
FROM customer WHERE {_GOOD_PAGE} AND (c_custkey % 3 <> 0 OR c_custkey % 4 <> 0)""")
def final_rows(fx):
    ck = F.col("c_custkey")
    row = F.struct(
        F.when(ck % 3 != 0, F.col("c_name")).alias("tournament"), F.concat(F.lit("Score "), s(ck)).alias("score"),
        F.when(ck % 4 != 0, F.struct(F.concat(F.lit("P"), s(ck)).alias("name"))).alias("winner_player"),
    )
    rows = ld.read_final_rows(fx.spark, list_files(fx, row, ck, "finals"))
    return rows.select(page_of(), "tournament", "score", F.col("winner_player.name").alias("winner"))


def parts(fx):
    ck = F.col("c_custkey")
    names = lambda x, y: F.array(F.concat(F.lit(x), s(ck)), F.lit(y))
    row = F.struct(F.concat(F.lit("k"), s(ck)).alias("key"), F.lit("Final").alias("round"), names("A", "B").alias("winners"), names("C", "D").alias("losers"))
    return ld.read_parts(fx.spark, list_files(fx, row, ck, "parts"))


@query("part_rows", f"SELECT {_PAGE} AS page, 'k' || c_custkey AS key, 'A' || c_custkey || '/B' AS winners, CAST(rank() OVER (PARTITION BY {_PAGE} ORDER BY c_custkey) - 1 AS BIGINT) AS ordinal FROM customer WHERE {_GOOD_PAGE}")
def part_rows(fx):
    return parts(fx)[0].select(page_of(), "key", F.concat_ws("/", "winners").alias("winners"), long("ordinal"))


@query("part_problems", f"SELECT DISTINCT {_PAGE} AS page, CASE WHEN {_PAGE} % 5 = 3 THEN 'no JSON' ELSE 'no list' END AS problem FROM customer WHERE NOT ({_GOOD_PAGE})")
def part_problems(fx):
    return parts(fx)[1].select(page_of(), "problem")


# --- tables in pages -----------------------------------------------------------------------------
_COUNTRIES = ("Spain", "Qatar", "Atlantis")


def calendar_pages(fx):
    k = F.col("p_partkey")
    o = F.date_add(F.lit("2020-01-10").cast("date"), (k % 330).cast("int"))
    when = F.when(k % 11 == 0, "Postponed").otherwise(F.concat(F.date_format(o, "d MMMM"), F.lit(" – "), F.date_format(F.date_add(o, 6), "d MMMM")))
    td = lambda c: F.concat(F.lit("<td><b>"), c, F.lit("</b>[3]</td>"))
    row = F.concat(F.lit("<tr>"), td(F.concat("p_name", pick(k % 4, " P1", " Major", " Finals", ""), F.lit(" "), s(k))), td(F.col("p_brand")), td(pick(k % 3, *_COUNTRIES)), td(when), F.lit("</tr>"))
    rows = fx.table("part").select(F.floor(k / 40).alias("page_id"), k, row.alias("row"))
    body = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "row"))).alias("rs"))
    html = F.concat(
        F.lit("<p>x</p><table class='other'><tr><td>Tournament</td></tr></table><table class='wikitable'><tr><th>Tournament</th><th>City</th><th>Country</th><th>Date</th></tr>"),
        F.concat_ws("", F.transform("rs", lambda x: x["row"])), F.lit("</table>"),
    )
    return body.select("page_id", html.alias("html"))


@query("calendar_table", """
SELECT p_name || [' P1', ' Major', ' Finals', ''][p_partkey % 4 + 1] || ' ' || p_partkey AS name, p_brand AS city, ['ES', 'QA', ''][p_partkey % 3 + 1] AS country,
  ['P1', 'Major', 'Finals', 'P1'][p_partkey % 4 + 1] AS category, strftime(DATE '2020-01-10' + CAST(p_partkey % 330 AS INT), '%Y-%m-%d') AS start,
  strftime(DATE '2020-01-10' + CAST(p_partkey % 330 AS INT) + 6, '%Y-%m-%d') AS "end" FROM part WHERE p_partkey % 11 <> 0""")
def calendar_table(fx):
    rows = pg.table_rows(calendar_pages(fx), ["Tournament", "Country", "Date"], "wikitable")
    return nm.calendar_rows(rows, F.lit(2020)).select("name", "city", "country", "category", d("start"), d("end"))


@query("year_end_table", """
SELECT CAST(1950 + c_custkey % 60 AS INT) AS year, 'A' || c_custkey AS authority, g AS gender, CASE g WHEN 'Men' THEN 'M1 ' ELSE 'W1 ' END || c_custkey AS first, 2 AS n, 'AR' AS code, 'Argentina X' AS country
FROM customer CROSS JOIN (VALUES ('Men'), ('Women')) t(g) WHERE g = 'Men' OR c_custkey % 3 <> 0""")
def year_end_table(fx):
    ck = s(F.col("c_custkey"))
    flag = F.lit("<td><img alt='AR flag' src='/uploads/2020/Argentina_X_Fip.png'></td>")
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    women = lambda t: F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(t), ck)).otherwise("")
    html = F.concat(
        F.lit("<table><tr><th>Year</th></tr><tr>"), td(s(1950 + F.col("c_custkey") % 60)), td(F.concat(F.lit("M1 "), ck)), flag, td(F.concat(F.lit("M2 "), ck)), flag,
        td(women("W1 ")), flag, td(women("W2 ")), flag, td(F.concat(F.lit("A"), ck)), F.lit("</tr></table>"),
    )
    pages = fx.table("customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    n = nm.no1_rows(pg.table_rows(pages, ["Year"]))
    return n.select("year", "authority", "gender", F.col("players")[0]["name"].alias("first"), F.size("players").alias("n"),
                    F.col("players")[0]["code"].alias("code"), F.col("players")[1]["country"].alias("country"))


@query("page_list_rows", r"""
SELECT page_id, r - 1 AS r, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(row, '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '\[\s*\d+\s*\]', '', 'g'), '\s+', ' ', 'g')) AS text FROM (
  SELECT page_id, unnest(l) AS row, generate_subscripts(l, 1) AS r FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>.*?</li>') AS l FROM pages))""")
def page_list_rows(fx):
    return pg.element_rows(fx.table("pages"), "li").select("page_id", long("r"), "text")


# --- keyed tables -----------------------------------------------------------------------------------
@query("latest_by_key", """
SELECT user_id AS key, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at,
  strftime((SELECT min(ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type <> 'error' AND f.event_id > coalesce((SELECT max(event_id) FROM events g WHERE g.user_id = e.user_id AND g.event_type = 'error'), -1)), '%Y-%m-%d %H:%M:%S') AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1 AND event_type <> 'error'""")
def latest_by_key(fx):
    ch = fx.table("events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").alias("updated_at"), "value", "event_type")
    out = tb.latest_by_key(ch, ["key"], ["updated_at", "event_id"], F.col("event_type") == "error", "updated_at")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("key", "value", stamp("updated_at"), stamp("created_at"))


cte("fx_copies", """
SELECT user_id + CASE WHEN user_id % 11 = 0 AND event_id % 2 = 0 THEN 1000000 ELSE 0 END AS key, CASE WHEN event_id % 2 = 0 THEN 'd1' ELSE 'static' END AS origin,
  CASE WHEN user_id % 7 = 0 AND event_id % 2 = 0 THEN 'bad' ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%S') END AS stamp, 'b' || max(event_id) AS body FROM events GROUP BY user_id, event_id % 2""")


def copies(fx):
    e, odd = fx.table("events"), F.col("event_id") % 2
    g = e.groupBy(F.col("user_id").alias("user"), odd.alias("odd")).agg(F.max("ts").alias("ts"), F.max("event_id").alias("m"))
    u = F.col("user")
    key = u + F.when((u % 11 == 0) & (F.col("odd") == 0), 1000000).otherwise(0)
    stamp = F.when((u % 7 == 0) & (F.col("odd") == 0), "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    g = g.select(key.alias("key"), F.when(F.col("odd") == 0, "d1").otherwise("static").alias("origin"), stamp.alias("stamp"), F.concat(F.lit("b"), s(F.col("m"))).alias("body"))
    # the stamp is read back out of the published text
    text = F.concat(F.lit('{"generatedAt": "'), F.col("stamp"), F.lit('", "x": 1}'))
    return g.withColumn("stamp", tb.body_stamp(text))


@query("freshest_copy", """
WITH x AS (SELECT key, max(body) FILTER (origin = 'd1') AS db, max(body) FILTER (origin = 'static') AS sb,
  coalesce(max(TRY_CAST(stamp AS TIMESTAMP)) FILTER (origin = 'd1'), TIMESTAMP '1970-01-01') AS ds, coalesce(max(TRY_CAST(stamp AS TIMESTAMP)) FILTER (origin = 'static'), TIMESTAMP '1970-01-01') AS ss FROM fx_copies GROUP BY 1)
SELECT key, CASE WHEN ds >= ss AND db IS NOT NULL THEN db ELSE sb END AS body, CASE WHEN ds >= ss AND db IS NOT NULL THEN 'd1' WHEN sb IS NOT NULL THEN 'static' ELSE 'none' END AS origin FROM x""", ("fx_copies",))
def freshest_copy(fx):
    return tb.freshest(copies(fx))


@query("preferred_copy", """
SELECT key, coalesce(max(body) FILTER (origin = 'd1'), max(body)) AS body, CASE WHEN count(*) FILTER (origin = 'd1') > 0 THEN 'd1' ELSE 'static' END AS origin FROM fx_copies GROUP BY 1""", ("fx_copies",))
def preferred_copy(fx):
    return tb.freshest(copies(fx), prefer="d1")


def snapshots(fx) -> str:
    """Two snapshots of the feed; the second is published twice."""
    path, feed = work(fx), fx.feed.drop("day")
    tb.write_snapshot(feed, "2024-01-01T10:00:00", path, "daily")
    tb.write_snapshot(feed.limit(1), "2024-01-02T10:00:00", path, "live")
    tb.write_snapshot(feed.where("status <> 'final'"), "2024-01-02T10:00:00", path, "live")
    return path


@query("snapshot_publish", """
SELECT '2024-01-01' AS date, 'daily' AS producer, count(*) AS count FROM fx_feed
UNION ALL SELECT '2024-01-02', 'live', count(*) FROM fx_feed WHERE status <> 'final'""", FEED)
def snapshot_publish(fx):
    return tb.snapshot_summary(fx.spark, snapshots(fx)).select("date", "producer", "count")


@query("snapshot_rows", "SELECT id, status, p0 || ' / ' || p1 AS team_a, '2024-01-02T10:00:00' AS snapshot_at FROM fx_feed WHERE status <> 'final'", FEED)
def snapshot_rows(fx):
    return tb.read_snapshot(fx.spark, snapshots(fx), "2024-01-02T10:00:00").select("id", "status", F.col("teams")[0]["name"].alias("team_a"), "snapshot_at")


@query("replace_slice", """
SELECT source, count(*) AS n, count(*) FILTER (status = 'new') AS replaced FROM (
  SELECT source, status FROM fx_feed WHERE source <> 'fip' UNION ALL SELECT source, 'new' FROM fx_feed WHERE source = 'fip') GROUP BY 1""", FEED)
def replace_slice(fx):
    old = fx.feed.select("source", "id", "status")
    new = old.where("source = 'fip'").withColumn("status", F.lit("new"))
    once = tb.replace_slice(old, new, F.col("source") == "fip")
    out = tb.replace_slice(once, new, F.col("source") == "fip")
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "new").alias("replaced"))


@query("bronze_replay", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def bronze_replay(fx):
    path = work(fx) + "/bronze"
    ld.write_bronze(fx.table("orders").withColumn("year", F.year("o_orderdate")), path)
    return ld.replay_bronze(fx.spark, path).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("guarded_overwrite", "SELECT o_orderkey AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def guarded_overwrite(fx):
    """The last version with enough rows: the one after it is refused."""
    path, orders = work(fx) + "/published", fx.table("orders")
    for version in orders.where("o_orderstatus <> 'F'"), orders, orders.where("o_orderkey < 0"):
        try:
            tb.guarded_overwrite(version, path)
        except tb.GuardFailed:
            continue
    return tb.published(fx.spark, path).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# --- exports -------------------------------------------------------------------------------------------
@query("sitemap", """
SELECT 'https://s' || p AS loc, l AS lastmod, f AS changefreq, r AS priority, 'core' AS kind FROM (VALUES ('/', '1998-06-15', 'hourly', '1.0'), ('/events', '1998-06-15', 'hourly', '0.8'),
  ('/rankings', '1998-06-15', 'daily', '0.8'), ('/results', '1998-06-15', 'daily', '0.7'), ('/players', NULL, 'weekly', '0.6')) t(p, l, f, r)
UNION ALL SELECT DISTINCT 'https://s/rankings/' || fed || '/' || category, '1998-06-15', 'daily', '0.7', 'ranking' FROM fx_ranking_rows
UNION ALL SELECT DISTINCT 'https://s/tournament/' || source || '/' || tid, '1998-06-15', 'hourly', '0.8', 'live' FROM fx_feed
UNION ALL SELECT 'https://s/tournament/rin/' || ordinal, strftime("end", '%Y-%m-%d'), 'monthly', '0.5', 'archive' FROM fx_archive_index
UNION ALL SELECT DISTINCT 'https://s/player/' || id, NULL, 'weekly', '0.5', 'player' FROM fx_ranking_rows WHERE id IS NOT NULL""", ("fx_ranking_rows", "fx_feed", "fx_archive_index"))
def sitemap(fx):
    return ex.sitemap(fx.feed, fx.archive_index, fx.ranking_rows, today(), "https://s")


@query("sitemap_xml", """
SELECT '  <url><loc>https://s/tournament/rin/' || ordinal || '</loc><lastmod>' || strftime("end", '%Y-%m-%d') || '</lastmod><changefreq>monthly</changefreq><priority>0.5</priority></url>' AS value FROM fx_archive_index""", ("fx_archive_index",))
def sitemap_xml(fx):
    return ex.sitemap_xml(ex.sitemap(fx.feed, fx.archive_index, fx.ranking_rows, today(), "https://s").where("kind = 'archive'"))


@query("tournament_metadata", """
SELECT key, json->>'name' AS name, json->>'organizer' IS NOT NULL AS has_organiser, json->'location'->>'name' AS place, json->>'startDate' AS start FROM (
  SELECT 'rin-' || c_custkey AS key, json_object('name', c_name, 'organizer', CASE WHEN c_custkey % 10 = 0 THEN 'x' END, 'location', CASE WHEN c_custkey % 2 = 0 THEN json_object('name', 'Hall ' || c_custkey)
    WHEN c_custkey % 3 = 0 THEN json_object('name', 'Road') END, 'startDate', '1998-06-15') AS json FROM customer)""")
def tournament_metadata(fx):
    ck = F.col("c_custkey")
    t = fx.table("customer").select(
        F.lit("rin").alias("source"), s(ck).alias("id"), F.col("c_name").alias("name"), F.lit("SE").alias("federation"),
        F.when(ck % 2 == 0, F.concat(F.lit("Hall "), s(ck))).alias("venue"), F.when(ck % 3 == 0, "Road").alias("address"),
        F.when(ck % 5 == 0, "Club").alias("organizer"), F.when(ck % 2 == 0, "/c").alias("organizer_url"), today().alias("start"), F.lit(None).cast("date").alias("end"),
    )
    j = ex.tournament_jsonld(t, "https://s")
    g = lambda p: F.get_json_object("json", p)
    return j.select(F.concat_ws("-", "source", "id").alias("key"), g("$.name").alias("name"), g("$.organizer").isNotNull().alias("has_organiser"), g("$.location.name").alias("place"), g("$.startDate").alias("start"))


@query("ranking_metadata", """
SELECT fed, category, CAST(count(*) AS VARCHAR) AS listed, min(name) FILTER (rn = 1) AS first, min(CASE WHEN id IS NULL THEN NULL ELSE 'https://s/player/' || id END) FILTER (rn = 1) AS url, CAST(least(count(*), 25) AS BIGINT) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY fed, category ORDER BY rank) AS rn FROM fx_last_lists) GROUP BY 1, 2""", ("fx_last_lists",))
def ranking_metadata(fx):
    g = lambda p: F.get_json_object("json", p)
    items = F.size(F.from_json(g("$.itemListElement"), "array<struct<name:string>>"))
    return ex.ranking_jsonld(fx.last_lists, "https://s").select(
        "fed", "category", g("$.numberOfItems").alias("listed"), g("$.itemListElement[0].name").alias("first"), g("$.itemListElement[0].url").alias("url"), items.cast("long").alias("items")
    )


@query("player_metadata", "SELECT id, name, country AS nationality, 'https://s/player/' || id AS url FROM fx_players", ("fx_players",))
def player_metadata(fx):
    g = lambda p: F.get_json_object("json", p)
    return ex.player_jsonld(fx.players, "https://s").select("id", g("$.name").alias("name"), g("$.nationality").alias("nationality"), g("$.url").alias("url"))


@query("player_summary_line", """
SELECT p.id, p.country || ' · ' || total || ' matches · ' || wins || '–' || (total - wins) || ' W–L · ' || CAST(floor(100.0 * wins / total + 0.5) AS INT) || '% win rate' AS line
FROM fx_players p JOIN (SELECT player_id, count(*) AS total, count(*) FILTER (is_winner = 1) AS wins FROM fx_match_players GROUP BY 1) t ON t.player_id = p.id""", ("fx_players", "fx_match_players"))
def player_summary_line(fx):
    t = h.totals(fx.match_players, fx.matches).withColumnRenamed("player_id", "id")
    return ex.player_summary_line(fx.players.join(t, "id"))

