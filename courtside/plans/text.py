"""Text, score, date and label functions over whole tables.

Texts are either the given documents or built from numbers, in which case the oracle
states the numbers and never parses the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions import dates as dt, labels as lb, scores as sc, text as tx
from courtside.plans.fixtures import pick, today
from courtside.plans.registry import cte, query

d = lambda c: F.date_format(c, "yyyy-MM-dd")
key = lambda: F.col("o_orderkey")
s = lambda c: c.cast("string")


def joined(sets):
    return F.concat_ws(" ", F.transform(sets, lambda x: F.concat_ws("-", x["a"], x["b"])))


# --- whole documents -----------------------------------------------------------------------------
_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


@query("clean_text", f"SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS h FROM documents")
def clean_text(fx):
    return fx.table("documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("h"))


@query("fold_text", "SELECT doc_id, md5(strip_accents(lower(text))) AS h FROM documents")
def fold_text(fx):
    return fx.table("documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("h"))


@query("slug_text", """
SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-')) AS h FROM documents""")
def slug_text(fx):
    return fx.table("documents").select("doc_id", F.md5(tx.slug(F.col("text"))).alias("h"))


@query("name_key", """
SELECT c_custkey AS id, least(a, b) || '+' || greatest(a, b) AS k FROM (
  SELECT c_custkey, lower(replace(replace(c_name, '#', ''), ' ', '')) AS a, lower(replace(n_name, '_', '')) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def name_key(fx):
    c = fx.table("customer").join(fx.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), tx.name_key(F.array("c_name", F.upper("n_name"))).alias("k"))


@query("token_overlap", """
WITH w AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+')) AS t FROM benchmark) WHERE length(t) > 2 AND t NOT IN ('the', 'of')),
n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1),
shared AS (SELECT a.item_id AS a, count(*) AS c FROM w a JOIN w b ON b.item_id = a.item_id + 1 AND a.t = b.t GROUP BY 1)
SELECT x.item_id AS a, round(CAST(coalesce(c, 0) AS DOUBLE) / least(x.n, y.n), 6) AS ov FROM n x JOIN n y ON y.item_id = x.item_id + 1 LEFT JOIN shared s ON s.a = x.item_id""")
def token_overlap(fx):
    b = fx.table("benchmark")
    t = lambda n: tx.tokens(F.col(n), 3, ("the", "of"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("a"), F.round(tx.overlap(t("text"), t("other")), 6).alias("ov"))


@query("strip_markup", r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '\[\s*\d+\s*\]', '', 'g'), '""" + _WS + """', ' ', 'g'))) AS h FROM pages""")
def strip_markup(fx):
    return fx.table("pages").select("page_id", F.md5(tx.strip_markup(F.col("html"))).alias("h"))


@query("article_text", r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'),
  '&#(8217|8216);', '''', 'g'), '&#(8211|8212);', '-', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS h FROM pages""")
def article_text(fx):
    return fx.table("pages").select("page_id", F.md5(tx.article_text(F.col("html"))).alias("h"))


@query("citations_entities_and_years", """
SELECT c_custkey AS id, c_name AS cited, c_name || ' & Co – x' AS decoded, 'Liga ' || (2000 + c_custkey % 30) AS unglued FROM customer""")
def citations(fx):
    ck = F.col("c_custkey")
    return fx.table("customer").select(
        ck.alias("id"), tx.strip_cites(F.concat(F.lit(" "), F.col("c_name"), F.lit("[12] [a][nb 3]"))).alias("cited"),
        tx.decode_entities(F.concat("c_name", F.lit("&nbsp;&amp; Co &#8211; x "))).alias("decoded"),
        tx.unglue_year(F.concat(F.lit("Liga"), s(2000 + ck % 30))).alias("unglued"),
    )


@query("undoubled_country", "SELECT n_nationkey AS id, c_custkey AS c, n_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' x' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def undoubled(fx):
    c = fx.table("customer").join(fx.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    twice = F.concat("n_name", F.lit("  "), F.col("n_name"))
    return c.select(
        F.col("n_nationkey").alias("id"), F.col("c_custkey").alias("c"),
        tx.undouble(F.when(F.col("c_custkey") % 2 == 0, twice).otherwise(F.concat("n_name", F.lit(" x")))).alias("country"),
    )


@query("player_labels", """
SELECT c_custkey AS id, c_name AS label, c_name || ' / P' || c_custkey AS pair, c_name AS first_of_pair, 2 AS n FROM customer""")
def player_labels(fx):
    ck = F.col("c_custkey")
    tail = pick(ck % 3, " [1, DA]", " (C)", " (C) [Q]")
    p = F.concat(F.lit("P"), s(ck))
    sep = pick(ck % 4, " y ", " and ", " & ", " Y ")
    lines = F.array(F.lit("3"), F.concat(F.lit("2. "), F.col("c_name"), F.lit(" (esp)")), p, F.lit("(esp-arg)"), F.lit("bye"))
    return fx.table("customer").select(
        ck.alias("id"), tx.player_label(F.concat("c_name", tail)).alias("label"),
        F.concat_ws(" / ", tx.pair_from_lines(F.when(ck % 2 == 0, lines).otherwise(F.array(F.concat("c_name", F.lit("/"), p))))).alias("pair"),
        tx.split_pair(F.concat("c_name", sep, p))[0].alias("first_of_pair"), F.size(tx.split_pair(F.concat("c_name", sep, p))).alias("n"),
    )


@query("same_pair", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 2 THEN FALSE ELSE TRUE END AS same, o_orderkey % 4 = 3 AS fused FROM orders""")
def same_pair(fx):
    k = key()
    a, b = F.concat(F.lit("Ana Garcia"), s(k)), F.concat(F.lit("Bea Lopezz"), s(k))
    p = F.array(a, b)
    long_a, long_b = F.concat(F.lit("Ána María García"), s(k)), F.concat(F.lit("Lopezz"), s(k), F.lit(" Sanz"))
    q = F.when(k % 4 == 0, F.array(long_a, long_b)).when(k % 4 == 1, F.array(long_b, long_a)).when(
        k % 4 == 2, F.array(a, F.lit("Bea Other"))).otherwise(p)
    stored = F.when(k % 4 == 3, F.array(F.concat_ws(" ", a, b))).otherwise(p)
    return fx.table("orders").select(k.alias("id"), tx.same_pair(p, q).alias("same"), tx.fused_pair(stored, p).alias("fused"))


@query("round_report", """
SELECT doc_id, TRUE AS hit FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 2 = 0""")
def round_report(fx):
    k = F.col("doc_id")
    text = F.concat("text", F.lit(" Málaga, demi-finale "), F.when(k % 2 == 0, "7-5").otherwise("xx"))
    title = F.when(k % 3 == 2, "Nice").otherwise("News")
    city = F.when(k % 3 == 2, F.lit("zzqq")).otherwise("MALAGA")
    bare = F.translate(text, "0123456789", "##########")
    text = F.when(k % 2 == 0, text).otherwise(bare)
    return fx.table("documents").select("doc_id", tx.is_round_report(title, text, city).alias("hit")).where("hit")


@query("not_played", "SELECT o_orderkey AS id, o_orderkey % 5 < 4 AS off FROM orders")
def not_played(fx):
    k = key()
    return fx.table("orders").select(
        k.alias("id"), tx.not_played(F.lit("Open"), pick(k % 5, "Cancelado", "No se disputó", "not held", "Suspendido", "Ana & Bea")).alias("off")
    )


@query("self_loss", "SELECT match_id, CAST(match_id % 3 = 0 AS BOOLEAN) AS self_loss FROM (SELECT o_orderkey AS match_id FROM orders)")
def self_loss(fx):
    from courtside.operators.filters import self_loss as check

    k = key()
    w = F.array(F.concat(F.lit("Ána "), s(k)), F.lit("Bea"))
    l = F.array(F.when(k % 3 == 0, F.concat(F.lit("ana-"), s(k))).otherwise("Eva"), F.lit("Zoe"))
    return fx.table("orders").select(k.alias("match_id"), check(w, l).alias("self_loss"))


@query("url_and_xml", """
SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS sub, 'a%20b%2F' || c_custkey || '!' AS seg, 'x &lt;' || c_custkey || '&gt; &amp;' AS xml FROM customer""")
def url_and_xml(fx):
    ck = s(F.col("c_custkey"))
    return fx.table("customer").select(
        F.col("c_custkey").alias("id"), tx.archive_sub_id(F.concat(F.lit("rin-"), ck), F.lit("rin")).alias("sub"),
        tx.url_segment(F.concat(F.lit("a b/"), ck, F.lit("!"))).alias("seg"),
        tx.xml_escape(F.concat(F.lit("x <"), ck, F.lit("> &"))).alias("xml"),
    )


# --- scores ------------------------------------------------------------------------------------------
_A, _B = "(o_orderkey % 7)", "(o_orderkey % 5)"
cte("fx_two_sets", f"SELECT o_orderkey AS id, {_A} || '-' || {_B} AS s1, {_B} || '-' || {_A} AS s2 FROM orders")


def two_sets():
    a, b = s(key() % 7), s(key() % 5)
    return a, b


@query("parse_sets_season", "SELECT id, s1 || ' ' || s2 AS sets FROM fx_two_sets", ("fx_two_sets",))
def parse_season(fx):
    (a, b), k = two_sets(), key()
    sep = pick(k % 4, " / ", ", ", " y ", " and ")
    return fx.table("orders").select(k.alias("id"), joined(sc.parse_sets(F.concat(a, F.lit("–"), b, sep, b, F.lit(" - "), a, F.lit(" [3]")), "season")).alias("sets"))


@query("parse_sets_circuit", "SELECT id, s1 || ' ' || s2 AS sets FROM fx_two_sets", ("fx_two_sets",))
def parse_circuit(fx):
    (a, b), k = two_sets(), key()
    return fx.table("orders").select(k.alias("id"), joined(sc.parse_sets(F.concat(a, F.lit("-"), b, pick(k % 2, "/", "  "), b, F.lit("-"), a, F.lit("(5) x4-4")), "circuit")).alias("sets"))


@query("parse_sets_news", "SELECT id, s1 || ' ' || s2 AS sets FROM fx_two_sets", ("fx_two_sets",))
def parse_news(fx):
    (a, b), k = two_sets(), key()
    tail = pick(k % 4, " ab.", " wo", " w/o", " ret.")
    return fx.table("orders").select(k.alias("id"), joined(sc.parse_sets(F.concat(a, F.lit("-"), b, F.lit("(6) "), b, F.lit("-"), a, tail), "news")).alias("sets"))


@query("parse_sets_bracket", "SELECT id, s1 || ' ' || s2 AS sets FROM fx_two_sets", ("fx_two_sets",))
def parse_bracket(fx):
    (a, b), k = two_sets(), key()
    return fx.table("orders").select(k.alias("id"), joined(sc.parse_sets(F.concat(a, F.lit("-"), b, F.lit(", "), b, F.lit("-"), a, F.lit(" ab.")), "bracket")).alias("sets"))


@query("bracket_score", """
SELECT id, s1 || ' ' || s2 || ['', ' ab.', ' wo'][id % 3 + 1] AS score, TRUE AS is_score, FALSE AS is_kickoff FROM fx_two_sets""", ("fx_two_sets",))
def bracket_score(fx):
    (a, b), k = two_sets(), key()
    t = F.concat(a, F.lit("/"), b, F.lit(" "), b, F.lit(" / "), a, pick(k % 3, "", " abandono", " w.o."))
    kick = F.concat(F.lit("mie "), s(k % 28 + 1), F.lit("/3 10.30"))
    return fx.table("orders").select(
        k.alias("id"), sc.bracket_score(t).alias("score"), sc.is_bracket_score(t).alias("is_score"), sc.is_bracket_score(kick).alias("is_kickoff")
    )


@query("set_cells", """
SELECT o_orderkey AS id, CASE WHEN glued THEN g ELSE t END AS games_text, CASE WHEN glued THEN tb END AS tie_break, CASE WHEN glued THEN g || '(' || tb || ')' ELSE t END AS label,
  CASE WHEN glued THEN CAST(g AS INT) ELSE n END AS games FROM (
  SELECT o_orderkey, o_orderkey % 3 = 0 AS glued, CAST(6 + o_orderkey % 2 AS VARCHAR) AS g, CAST(o_orderkey % 12 AS VARCHAR) AS tb,
    CASE o_orderkey % 3 WHEN 1 THEN '' || (o_orderkey % 6) ELSE '10' END AS t, CASE o_orderkey % 3 WHEN 1 THEN o_orderkey % 6 ELSE 10 END AS n FROM orders)""")
def set_cells(fx):
    k = key()
    c = F.when(k % 3 == 0, F.concat(s(6 + k % 2), s(k % 12))).when(k % 3 == 1, s(k % 6)).otherwise("10")
    p = sc.set_parts(c)
    return fx.table("orders").select(
        k.alias("id"), p["games"].alias("games_text"), p["tie_break"].alias("tie_break"), p["label"].alias("label"), sc.games(c).alias("games")
    )


@query("percent", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 + o_orderkey % 5 > 0 THEN CAST(floor(100.0 * (o_orderkey % 7) / (o_orderkey % 7 + o_orderkey % 5) + 0.5) AS BIGINT) ELSE -1 END AS pct FROM orders""")
def percent(fx):
    return fx.table("orders").select(key().alias("id"), F.coalesce(sc.percent(key() % 7, key() % 5), F.lit(-1)).cast("long").alias("pct"))


@query("pair_cells", """
SELECT o_orderkey AS id, '6-' || (o_orderkey % 5) || CASE WHEN o_orderkey % 2 = 0 THEN ' 3-' ELSE '' END AS sets FROM orders""")
def pair_cells(fx):
    k = key()
    a = F.array(F.lit("6"), F.when(k % 2 == 0, "3").otherwise("-"), F.lit(""))
    return fx.table("orders").select(k.alias("id"), joined(sc.pair_cells(a, F.array(s(k % 5), F.lit("-")))).alias("sets"))


# --- dates ---------------------------------------------------------------------------------------------
@query("date_range", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS start,
  CASE WHEN o_orderkey % 11 <> 0 THEN strftime(CAST(o_orderdate AS DATE) + 7, '%Y-%m-%d') END AS "end" FROM orders""")
def date_range(fx):
    k, o = key(), F.col("o_orderdate").cast("date")
    text = F.concat(F.date_format(o, "d MMMM"), pick(k % 2, " – ", " - "), F.date_format(F.date_add(o, 7), "d MMMM"))
    r = dt.date_range(F.when(k % 11 == 0, "Postponed").otherwise(text), F.year(o))
    return fx.table("orders").select(k.alias("id"), d(r["start"]).alias("start"), d(r["end"]).alias("end"))


@query("card_dates", """
SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE ',' || strftime(CAST(o_orderdate AS DATE) + 3, '%Y-%m-%d') END AS dates FROM orders""")
def card_dates(fx):
    k, o = key(), F.col("o_orderdate").cast("date")
    f = lambda p: F.concat_ws(" to ", F.date_format(o, p), F.date_format(F.date_add(o, 3), p))
    t = F.when(k % 3 == 0, f("dd.MM.yyyy")).when(k % 3 == 1, f("d MMM yyyy")).otherwise(F.date_format(o, "dd/MM/yyyy"))
    return fx.table("orders").select(
        k.alias("id"), F.concat_ws(",", F.transform(dt.first_dates(F.concat(F.lit("Cup, "), t, F.lit(" hall 7"))), d)).alias("dates")
    )


_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


@query("season_start", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate, '%Y-%m-%d') AS dmy FROM orders")
def season_start(fx):
    k, o = key(), F.col("o_orderdate").cast("date")
    es = F.concat(F.date_format(o, "d"), F.lit(" de "), pick(F.month(o) - 1, *_ES), F.lit(" al 30 de junio"))
    t = F.when(k % 2 == 0, es).otherwise(F.date_format(o, "d MMMM"))
    return fx.table("orders").select(
        k.alias("id"), d(dt.season_start(t, F.year(o))).alias("start"), d(dt.dmy_date(F.date_format(o, "dd/MM/yyyy"))).alias("dmy")
    )


@query("clock_texts", """
SELECT o_orderkey AS id, m AS clock, m AS clock12, CAST(m + 60 * 24 AS BIGINT) AS dur, lpad('' || (m // 60), 2, '0') || ':' || lpad('' || (m % 60), 2, '0') AS hhmm,
  CASE WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' WHEN m > 0 THEN m || ' min' END AS label FROM (SELECT o_orderkey, o_orderkey % 1440 AS m FROM orders)""")
def clock_texts(fx):
    m = key() % 1440
    hh, mm = F.floor(m / 60), F.lpad(s(m % 60), 2, "0")
    h12 = F.when(hh % 12 == 0, 12).otherwise(hh % 12)
    twelve = F.concat(F.lit("Not before "), s(h12), F.lit(":"), mm, F.when(hh >= 12, " pm").otherwise(" AM"))
    return fx.table("orders").select(
        key().alias("id"), dt.clock_minutes(F.concat(s(hh), F.lit(":"), mm)).cast("long").alias("clock"), dt.clock_minutes(twelve).cast("long").alias("clock12"),
        dt.duration_minutes(F.concat(s(hh + 24), F.lit(":"), mm)).cast("long").alias("dur"), dt.format_minutes(m + 2880).alias("hhmm"),
        dt.duration_label(F.concat(s(hh), F.lit(":"), mm)).alias("label"),
    )


@query("range_labels", """
SELECT o_orderkey AS id, CASE WHEN month(a) = month(b) THEN day(a) || '–' || day(b) || strftime(a, ' %b') ELSE day(a) || strftime(a, ' %b') || ' – ' || day(b) || strftime(b, ' %b') END AS label,
  CASE WHEN o_orderkey % 5 = 0 THEN day(a) || strftime(a, ' %b %Y') WHEN month(a) = month(b) THEN day(a) || '–' || day(b) || strftime(b, ' %b %Y')
    ELSE day(a) || strftime(a, ' %b') || ' – ' || day(b) || strftime(b, ' %b %Y') END || ' · draw & results' AS card,
  strftime(a, '%a %-d %b') AS heading, strftime(a - 9, '%Y-%m-%d') AS shifted FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 6 AS b FROM orders)""")
def range_labels(fx):
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, 6)
    return fx.table("orders").select(
        key().alias("id"), dt.range_label(a, b).alias("label"), dt.card_range_label(a, F.when(key() % 5 != 0, b)).alias("card"),
        dt.day_heading(a).alias("heading"), d(F.date_add(a, -9)).alias("shifted"),
    )


@query("day_and_month_distance", """
SELECT o_orderkey AS id, CAST(abs(CAST(o_orderdate AS DATE) - DATE '1998-06-15') AS BIGINT) AS days, CAST(least(abs(month(o_orderdate) - 1), 12 - abs(month(o_orderdate) - 1)) AS BIGINT) AS months FROM orders""")
def distances(fx):
    o = F.col("o_orderdate").cast("date")
    return fx.table("orders").select(
        key().alias("id"), dt.day_diff(o, today()).cast("long").alias("days"), dt.month_distance(F.month(o), F.lit(1)).cast("long").alias("months")
    )


# --- labels -----------------------------------------------------------------------------------------------
_ROUNDS = {
    "Grand Final": 100, "Semi-finals": 90, "Quarterfinals": 80, "3rd place": 85, "Round of 16": 70, "1/16": 60, "R64": 50, "Runde 1": 40,
    "Gruppe B": 20, "Q2": 15, "Norte": 30, "Kvartsfinal": 80,
}


@query("round_rank", "SELECT o_orderkey AS id, [" + ",".join(map(str, _ROUNDS.values())) + f"][o_orderkey % {len(_ROUNDS)} + 1] AS rank, o_orderkey % {len(_ROUNDS)} IN (0,1,2,4,5,6,11) AS ko, o_orderkey % {len(_ROUNDS)} = 0 AS final FROM orders")
def round_rank(fx):
    r = pick(key() % len(_ROUNDS), *_ROUNDS)
    return fx.table("orders").select(
        key().alias("id"), lb.round_rank(r).alias("rank"), lb.is_knockout(r).alias("ko"), lb.is_final_round(r).alias("final")
    )


_ES_ROUNDS = {"1ª ronda": "Qualifying", "Segunda ronda": "Qualifying", "32avos": "Round of 64", "16 º": "Round of 32", "Octavos": "Round of 16",
              "1/4": "Quarterfinal", "Semifinales": "Semifinal", " Final": "Final", "Clasificados": "Qualifying"}
_FR_ROUNDS = {"demi-finale": "Semifinal", "quarts de finale": "Quarterfinal", "huitièmes de finale": "Round of 16", "1/16": "Round of 32",
              "qualifs": "Qualifying", "finale": "Final"}
_list = lambda v: "[" + ",".join(f"'{x}'" for x in v) + "]"


@query("round_labels", f"SELECT o_orderkey AS id, {_list(_ES_ROUNDS.values())}[o_orderkey % 9 + 1] AS draw, {_list(_FR_ROUNDS.values())}[o_orderkey % 6 + 1] AS news FROM orders")
def round_labels(fx):
    return fx.table("orders").select(
        key().alias("id"), lb.draw_round(pick(key() % 9, *_ES_ROUNDS)).alias("draw"), lb.news_round(pick(key() % 6, *_FR_ROUNDS)).alias("news")
    )


_EV = {"Riyadh Major": ("Major", "Major", 100), "Season Finals": ("Finals", "Finals", 100), "Gijón P1": ("P1", "P1", 90), "Rome p2": ("P2", "P2", 80),
       "FIP Gold X": ("P1", "Gold", 70), "Silverstone": ("P1", "Silver", 0), "Promises Cup": ("P1", "Promises", 30), "Open P10": ("P1", "FIP", 0)}


@query("event_categories", f"""SELECT o_orderkey AS id, {_list([v[0] for v in _EV.values()])}[o_orderkey % 8 + 1] AS calendar, {_list([v[1] for v in _EV.values()])}[o_orderkey % 8 + 1] AS event,
  [{','.join(str(v[2]) for v in _EV.values())}][o_orderkey % 8 + 1] AS tier FROM orders""")
def event_categories(fx):
    n = pick(key() % 8, *_EV)
    return fx.table("orders").select(
        key().alias("id"), lb.calendar_category(n).alias("calendar"), lb.event_category(n).alias("event"), lb.tier(n).alias("tier")
    )


@query("competition_format", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Tournament' WHEN o_orderkey % 3 < 2 THEN 'League' ELSE 'Tournament' END AS fmt FROM orders")
def competition_format(fx):
    return fx.table("orders").select(
        key().alias("id"), lb.competition_format(key() % 5 == 0, pick(key() % 3, "Liga Sur", "Team Serien", "Ligament Cup")).alias("fmt")
    )


@query("countries_and_regions", """
SELECT o_orderkey AS id, ['ES', 'DK', NULL, NULL, 'SA'][o_orderkey % 5 + 1] AS code, ['ES', 'US', ''][o_orderkey % 3 + 1] AS named, ['FIP International', 'Denmark', 'QQ'][o_orderkey % 3 + 1] AS region FROM orders""")
def countries(fx):
    return fx.table("orders").select(
        key().alias("id"), lb.country_code(pick(key() % 5, "esp", " dk", ".JPG", "QQQ", "KSA")).alias("code"),
        lb.country_of_name(pick(key() % 3, "Spain", "United States", "Atlantis")).alias("named"), lb.region_label(pick(key() % 3, "FIP", "DK", "QQ")).alias("region"),
    )


@query("circuit_of_tournament", """
SELECT key, coalesce(tour, CASE WHEN federation = 'FIP' THEN 'FIP' END) AS circuit, coalesce(tour, 'WPT') AS stamped, strftime(start, '%Y') AS year FROM fx_archive_index""", ("fx_archive_index",))
def circuit(fx):
    return fx.archive_index.select(
        "key", lb.circuit(F.col("tour"), F.col("federation")).alias("circuit"), lb.legacy_tour(F.col("tour")).alias("stamped"), F.date_format("start", "yyyy").alias("year")
    )


@query("category_and_header_split", """
SELECT id, coalesce(class_name, 'Men') AS cls, base_round AS round, 'A' || ck AS head_class, 'Runde ' || (k % 4) AS head_round FROM fx_feed""", ("fx_feed",))
def category_split(fx):
    x = lb.split_category(F.col("class_name"), F.col("round"))
    h = lb.split_header(F.concat(F.lit("A"), F.col("tournament.id"), F.lit(" Runde "), s(F.col("ordinal") % 4)))
    return fx.feed.select("id", x["cls"].alias("cls"), x["round"].alias("round"), h["class_name"].alias("head_class"), h["round"].alias("head_round"))


@query("gender_label", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'Women' ELSE 'Men' END AS gender, CASE WHEN o_orderkey % 4 = 0 THEN 'Men' ELSE 'Women' END AS with_dam FROM orders")
def gender_label(fx):
    g = pick(key() % 4, "male", "FEMALE", "women", "Damer")
    return fx.table("orders").select(key().alias("id"), lb.gender_of(g).alias("gender"), lb.gender_of(g, True).alias("with_dam"))
