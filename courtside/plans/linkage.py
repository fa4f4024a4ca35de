"""Record linkage over derived archives, draws and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions.scores import parse_sets
from courtside.operators import filters as fl, linkage as ln, normalise as nm, schedule as sch
from courtside.plans.fixtures import draw_pair, first_winner, pick, second_winner, season
from courtside.plans.registry import cte, query
from courtside.session import cut
from courtside.sources.pages import draw_cells

d = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
s = lambda c: c.cast("string")
long = lambda c: F.col(c).cast("long").alias(c)

# --- final rows to tournaments -----------------------------------------------------------------
cte("fx_words", "SELECT ordinal, w FROM (SELECT ordinal, unnest(string_split(name, ' ')) AS w FROM fx_archive_names) WHERE length(w) > 2", ("fx_archive_names",))
cte("fx_name_overlap", """
SELECT a.name AS n1, b.name AS n2, len(list_intersect(a.ws, b.ws)) / CAST(2 AS DOUBLE) AS ov FROM (SELECT DISTINCT name, string_split(name, ' ') AS ws FROM fx_archive_names) a
CROSS JOIN (SELECT DISTINCT name, string_split(name, ' ') AS ws FROM fx_archive_names) b""", ("fx_archive_names",))
cte("fx_links", """
SELECT row_id, key, round(score, 6) AS score FROM (
  SELECT r.row_id, t.key, sc.score, row_number() OVER (PARTITION BY r.row_id ORDER BY sc.score DESC, t.ordinal) AS rn
  FROM fx_final_rows r JOIN fx_archive_names t ON t.year = r.year JOIN fx_name_overlap o ON o.n1 = r.name AND o.n2 = t.name
  CROSS JOIN LATERAL (SELECT CASE WHEN r.city <> '' AND t.city IS NOT NULL AND (contains(t.city, r.city) OR contains(r.city, t.city)) THEN 3 ELSE 0 END + 3 * o.ov
    + coalesce(CASE WHEN abs(r.final_date - t.start) <= 10 THEN 1.5 - abs(r.final_date - t.start) / 10.0 ELSE 0 END, 0) AS score) sc
  WHERE sc.score >= 2.5) WHERE rn = 1""", ("fx_final_rows", "fx_archive_names", "fx_name_overlap"))


@query("link_finals", "SELECT row_id, key, score FROM fx_links", ("fx_links",))
def link_finals(fx):
    return ln.link_finals(fx.final_rows, fx.archive_names)


# finals of a third of the tournaments are missing, a third are fused, the rest complete
def pair_text(k, who):
    return F.array(F.concat(F.lit(f"{who} Anna"), s(k)), F.concat(F.lit(f"{who} Berta"), s(k)))


def reconcile_inputs(fx):
    o = F.col("ordinal")
    fused = F.array(F.concat_ws(" ", pair_text(o, "Win")))
    finals = fx.archive_names.select(
        F.when(o % 3 == 0, F.concat(F.lit("none-"), s(o))).otherwise(F.col("key")).alias("key"), F.lit("Men").alias("gender"), F.when(o % 3 == 1, fused).otherwise(pair_text(o, "Win")).alias("winners"),
        pair_text(o, "Run").alias("runners_up"), F.lit("6-4 6-4").alias("score"),
        F.when(o % 3 == 2, F.array(s(o))).alias("winner_ids"), F.lit(None).cast("array<string>").alias("runner_ids"), F.lit("wiki").alias("source"),
    )
    # two rows per tournament: the right pair (swapped), then another pair for every fifth one
    rows = fx.archive_names.select("key", o.alias("o"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    k = F.col("o")
    right = F.array(pair_text(k, "Win")[1], pair_text(k, "Win")[0])
    other = F.array(F.lit("Zoe Other"), F.lit("Yara Someone"))
    linked = rows.select(
        (k * 2 + F.col("i")).alias("row_id"), (k * 2 + F.col("i")).alias("ordinal"), "key", F.lit("Men").alias("gender"),
        F.when((k % 5 == 0) & (F.col("i") == 1), other).otherwise(right).alias("winners"), pair_text(k, "Run").alias("runners_up"),
        F.lit("6-1 6-1").alias("score"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(s(k), s(k + 1))).alias("winner_ids"),
        F.array(F.lit("r")).alias("runner_ids"),
    )
    return linked, finals


@query("reconcile_outcomes", """
SELECT k * 2 + i AS row_id, CASE WHEN i = 1 AND k % 5 = 0 THEN 'conflict' WHEN i = 0 AND k % 3 = 0 THEN 'filled' WHEN i = 0 AND k % 3 = 1 THEN 'repaired'
  WHEN i = 0 THEN 'ids added' ELSE 'already complete' END AS outcome
FROM (SELECT p_partkey AS k FROM part) CROSS JOIN (VALUES (0), (1)) t(i)""")
def reconcile_outcomes(fx):
    return ln.reconcile(*reconcile_inputs(fx))[1].select("row_id", "outcome")


@query("reconcile_updates", """
SELECT 't-' || k AS key, CASE WHEN k % 3 = 2 THEN 'Win Anna' || k || '/Win Berta' || k ELSE 'Win Berta' || k || '/Win Anna' || k END AS winners,
  CASE WHEN k % 3 = 0 THEN '6-1 6-1' ELSE '6-4 6-4' END AS score, CASE WHEN k % 3 = 2 THEN '' || k WHEN k % 7 = 0 THEN '' ELSE k || ',' || (k + 1) END AS winner_ids,
  'r' AS runner_ids, CASE WHEN k % 3 = 0 THEN 'FIP' ELSE 'wiki' END AS source FROM (SELECT p_partkey AS k FROM part)""")
def reconcile_updates(fx):
    u = ln.reconcile(*reconcile_inputs(fx))[0]
    return u.select("key", F.concat_ws("/", "winners").alias("winners"), "score", F.concat_ws(",", "winner_ids").alias("winner_ids"),
                    F.concat_ws(",", "runner_ids").alias("runner_ids"), "source")


@query("reconcile_report", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN i = 1 AND k % 5 = 0 THEN 'conflict' WHEN i = 0 AND k % 3 = 0 THEN 'filled' WHEN i = 0 AND k % 3 = 1 THEN 'repaired'
  WHEN i = 0 THEN 'ids added' ELSE 'already complete' END AS outcome FROM (SELECT p_partkey AS k FROM part) CROSS JOIN (VALUES (0), (1)) t(i)) GROUP BY 1""")
def reconcile_report(fx):
    return ln.outcome_report(ln.reconcile(*reconcile_inputs(fx))[1])


@query("missing_finals", "SELECT key FROM fx_archive_names WHERE ordinal % 3 = 0", ("fx_archive_names",))
def missing_finals(fx):
    return ln.missing_finals(fx.archive_names, reconcile_inputs(fx)[1], "Men").select("key")


# --- season schedule and merge -----------------------------------------------------------------------
cte("fx_schedule", """
SELECT year AS season, name || ' ' || substr(city, 1, 6) || (ordinal % 40) AS name, min(ordinal) AS ordinal FROM fx_archive_names WHERE city IS NOT NULL GROUP BY 1, 2""", ("fx_archive_names",))


def schedule_inputs(fx):
    t = fx.archive_names.where("city is not null")
    name = F.concat("name", F.lit(" "), F.substring("city", 1, 6), s(F.col("ordinal") % 40))
    schedule = t.groupBy(F.col("year").alias("season"), name.alias("name")).agg(F.min("ordinal").alias("ordinal"))
    results = fx.archive_names.select(
        F.col("year").alias("season"), F.when(F.col("ordinal") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" Brand#0 x"))).alias("name")
    ).distinct()
    return results, schedule


@query("resolve_schedule", """
WITH r AS (SELECT DISTINCT year AS season, CASE WHEN ordinal % 2 = 0 THEN upper(name) ELSE name || ' Brand#0 x' END AS name,
    trim(regexp_replace(lower(CASE WHEN ordinal % 2 = 0 THEN name ELSE name || ' Brand#0 x' END), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM fx_archive_names),
k AS (SELECT season, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS k, arg_max(name, ordinal) AS full_name, min(ordinal) AS ordinal FROM fx_schedule GROUP BY 1, 2)
SELECT r.season, r.name, coalesce(e.full_name, c.full_name, r.name) AS full_name, CASE WHEN e.k IS NOT NULL THEN 'equal' WHEN c.full_name IS NOT NULL THEN 'contained' ELSE 'as is' END AS how
FROM r LEFT JOIN k e ON e.season = r.season AND e.k = r.s
LEFT JOIN (SELECT r.season, r.s, arg_max(k.full_name, length(k.k) * 10000000 - k.ordinal) AS full_name FROM r JOIN k ON k.season = r.season AND (contains(k.k, r.s) OR contains(r.s, k.k)) GROUP BY 1, 2) c
  ON c.season = r.season AND c.s = r.s""", ("fx_archive_names", "fx_schedule"))
def resolve_schedule(fx):
    return ln.resolve_schedule(*schedule_inputs(fx))


def season_inputs(fx):
    o = F.col("ordinal")
    final = lambda tag, two, scored: F.struct(
        F.when(two, F.array(F.lit(f"{tag}1"), F.lit(f"{tag}2"))).otherwise(F.array(F.lit(f"{tag}1"))).alias("winners"),
        F.array(F.lit("x"), F.lit("y")).alias("runners_up"), F.lit("6-4").alias("score"),
        F.when(scored, F.array(F.lit("6-4"))).otherwise(F.array().cast("array<string>")).alias("sets"),
    )
    base = fx.archive_names.select("key", F.col("year").alias("season"), "ordinal", "name", "city", F.lit(None).cast("string").alias("country"), "start")
    spine = base.withColumn("finals", F.create_map(F.lit("Men"), final("s", o % 2 == 0, o % 4 < 2)))
    # the other language: same key for even rows, a foreign key three days later for odd ones
    other = fx.archive_names.select(
        F.when(o % 2 == 0, F.col("key")).otherwise(F.concat(F.lit("es-"), s(o))).alias("key"), F.col("year").alias("season"), "ordinal", "name",
        F.lit("Ciudad").alias("city"), F.lit("ES").alias("country"),
        F.when(o % 6 == 1, F.make_date("year", F.lit(12), F.lit(1))).otherwise(F.date_add("start", 3)).alias("start"),
    )
    other = other.withColumn("finals", F.create_map(F.lit("Men"), final("o", F.lit(True), F.lit(True)), F.lit("Women"), final("w", F.lit(True), o % 4 < 2)))
    return spine, other


cte("fx_merge_target", """
SELECT o.ordinal, o.okey, coalesce(e.key, n.target) AS target FROM (
  SELECT ordinal, year, CASE WHEN ordinal % 2 = 0 THEN key ELSE 'es-' || ordinal END AS okey,
    CASE WHEN ordinal % 6 = 1 THEN make_date(year, 12, 1) ELSE start + 3 END AS start FROM fx_archive_names) o
LEFT JOIN fx_archive_names e ON e.key = o.okey
LEFT JOIN (SELECT o2.ordinal, arg_min(t.key, t.ordinal) AS target FROM (
    SELECT ordinal, year, CASE WHEN ordinal % 6 = 1 THEN make_date(year, 12, 1) ELSE start + 3 END AS start FROM fx_archive_names WHERE ordinal % 2 = 1) o2
  JOIN fx_archive_names t ON t.year = o2.year AND abs(t.start - o2.start) <= 4 GROUP BY 1) n ON n.ordinal = o.ordinal""", ("fx_archive_names",))


@query("merge_seasons_unmatched", "SELECT okey AS key FROM fx_merge_target WHERE target IS NULL", ("fx_merge_target",))
def merge_unmatched(fx):
    return ln.merge_seasons(*season_inputs(fx))[2].select("key")


@query("merge_seasons_finals", """
SELECT key, gender, arg_max(w, comp * 100000000 + (1 - lang) * 10000000 - ordinal) AS first_winner, max(comp) AS completeness FROM (
  SELECT key, 'Men' AS gender, 's1' AS w, CASE WHEN ordinal % 2 = 0 THEN 2 ELSE 1 END + 2 + CASE WHEN ordinal % 4 < 2 THEN 1 ELSE 0 END AS comp, 0 AS lang, ordinal FROM fx_archive_names
  UNION ALL SELECT target, 'Men', 'o1', 5, 1, ordinal FROM fx_merge_target WHERE target IS NOT NULL
  UNION ALL SELECT target, 'Women', 'w1', 4 + CASE WHEN ordinal % 4 < 2 THEN 1 ELSE 0 END, 1, ordinal FROM fx_merge_target WHERE target IS NOT NULL) GROUP BY 1, 2""", ("fx_merge_target", "fx_archive_names"))
def merge_finals(fx):
    f = ln.merge_seasons(*season_inputs(fx))[1]
    comp = ln.completeness(F.col("winners"), F.col("runners_up"), F.col("sets"))
    return f.select("key", "gender", F.col("winners")[0].alias("first_winner"), comp.alias("completeness"))


@query("merge_seasons_facts", """
SELECT n.key, coalesce(n.city || ' (x)', CASE WHEN m.n > 0 THEN 'Ciudad' END) AS city, CASE WHEN m.n > 0 THEN 'ES' END AS country,
  strftime(coalesce(n.start, m.start), '%Y-%m-%d') AS start
FROM fx_archive_names n LEFT JOIN (
  SELECT target, count(*) AS n, arg_min(CASE WHEN t.ordinal % 6 = 1 THEN make_date(year, 12, 1) ELSE start + 3 END, t.ordinal) AS start
  FROM fx_merge_target t JOIN fx_archive_names a ON a.ordinal = t.ordinal WHERE target IS NOT NULL GROUP BY 1) m ON m.target = n.key""", ("fx_merge_target", "fx_archive_names"))
def merge_facts(fx):
    return ln.merge_seasons(*season_inputs(fx))[0].select("key", "city", "country", d("start"))


# a fourth of the events have no start of their own; where the other language has their key, it fills one
cte("fx_gap_spine", """
SELECT key, ordinal, year AS season, CASE WHEN (ordinal // 10) % 4 = 1 THEN NULL ELSE start END AS start FROM fx_archive_names""", ("fx_archive_names",))
cte("fx_gap_other", """
SELECT CASE WHEN (ordinal // 10) % 3 <> 0 THEN key ELSE 'es-' || ordinal END AS key, ordinal, year AS season, start + 2 AS start,
  row_number() OVER (PARTITION BY year ORDER BY ordinal) AS rn FROM fx_archive_names""", ("fx_archive_names",))


def gap_inputs(fx):
    tens = F.floor(F.col("ordinal") / 10)
    final = lambda who: F.struct(
        F.array(who, F.lit("x")).alias("winners"), F.array(F.lit("y"), F.lit("z")).alias("runners_up"),
        F.lit("6-4").alias("score"), F.array(F.lit("6-4")).alias("sets"))
    rows = fx.archive_names.select(
        "key", F.col("year").alias("season"), "ordinal", "name", "city", F.lit(None).cast("string").alias("country"), "start")
    spine = rows.withColumn("start", F.when(tens % 4 != 1, F.col("start")))
    spine = spine.withColumn("finals", F.create_map(F.lit("Men"), final(F.col("key"))))
    other = rows.withColumn("key", F.when(tens % 3 != 0, F.col("key")).otherwise(F.concat(F.lit("es-"), s(F.col("ordinal")))))
    other = other.withColumn("start", F.date_add("start", 2)).withColumn("finals", F.create_map(F.lit("Women"), final(F.col("key"))))
    return spine, other


@query("merge_seasons_filled", """
WITH RECURSIVE sim AS (
  SELECT season, CAST(0 AS BIGINT) AS n, list({'k': key, 's': start} ORDER BY ordinal) AS events,
    CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS target FROM fx_gap_spine GROUP BY 1
  UNION ALL
  SELECT season, n, CASE WHEN target IS NULL THEN events ELSE
      list_transform(events, lambda e: {'k': e.k, 's': CASE WHEN e.k = target AND e.s IS NULL THEN start ELSE e.s END}) END, key, target
  FROM (SELECT sim.season, sim.n + 1 AS n, events, o.key, o.start,
      coalesce(list_filter(events, lambda e: e.k = o.key)[1].k, list_filter(events, lambda e: abs(e.s - o.start) <= 4)[1].k) AS target
    FROM sim JOIN fx_gap_other o ON o.season = sim.season AND o.rn = sim.n + 1))
SELECT 'final' AS kind, target AS key, arg_min(key, n) AS value FROM sim WHERE target IS NOT NULL GROUP BY 2
UNION ALL SELECT 'unmatched', key, NULL FROM sim WHERE n > 0 AND target IS NULL
UNION ALL SELECT 'start', e.k, strftime(e.s, '%Y-%m-%d') FROM (SELECT unnest(arg_max(events, n)) AS e FROM sim GROUP BY season)""", ("fx_gap_spine", "fx_gap_other"))
def merge_filled(fx):
    """What a season told in two languages comes to when the order of reading decides which starts are known."""
    facts, finals, unmatched = ln.merge_seasons(*gap_inputs(fx))
    women = finals.where("gender = 'Women'").select(F.lit("final").alias("kind"), "key", F.col("winners")[0].alias("value"))
    left = unmatched.select(F.lit("unmatched").alias("kind"), "key", F.lit(None).cast("string").alias("value"))
    return women.unionByName(left).unionByName(facts.select(F.lit("start").alias("kind"), "key", d("start").alias("value")))


@query("longest_table", """
SELECT year, gender, table_id, n FROM (SELECT *, row_number() OVER (PARTITION BY year, gender ORDER BY n DESC, table_id) AS rn FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender, o_orderkey % 3 AS table_id, count(*) AS n FROM orders GROUP BY ALL)) WHERE rn = 1""")
def longest_table(fx):
    rows = fx.table("orders").select(
        F.year("o_orderdate").alias("year"), F.when(F.col("o_custkey") % 2 == 0, "Men").otherwise("Women").alias("gender"), (F.col("o_orderkey") % 3).alias("table_id")
    )
    return ln.longest_table(rows).groupBy("year", "gender", "table_id").agg(F.count("*").alias("n"))


@query("carry_rounds", """
SELECT key, ordinal FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'gone-' ELSE 't-' END || p_partkey AS key, p_partkey AS ordinal FROM part) WHERE key IN (SELECT key FROM fx_archive_names)""", ("fx_archive_names",))
def carry_rounds(fx):
    old = fx.archive_names.select(F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("gone-"), s(F.col("ordinal")))).otherwise(F.col("key")).alias("key"), "ordinal")
    return ln.carry_rounds(fx.archive_names, old)


# --- circuit finals ------------------------------------------------------------------------------------
def circuit_raw(fx):
    k = F.col("o_orderkey")
    player = lambda tag: F.struct(F.concat(F.lit(f" {tag}  "), s(k)).alias("name"), F.concat(F.when(k % 5 == 0, "nd").otherwise("p"), s(k), F.lit(tag)).alias("player_id"))
    return fx.table("orders").select(
        k.alias("ordinal"), F.lit("WPT").alias("circuit"), F.date_format("o_orderdate", "yyyy").alias("year"),
        F.concat(F.lit("Málaga  Open "), s(F.col("o_custkey"))).alias("tournament"), F.lit(" Málaga ").alias("city"), F.struct(F.lit("Spain").alias("name")).alias("country"),
        F.when(k % 7 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("final_date"), F.when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(k % 3 == 0, "6-4/7-5").otherwise("6-4 7-5").alias("score"), player("W").alias("winner_player"), player("V").alias("winner_partner"),
        player("R").alias("finalist"), player("S").alias("finalist_partner"),
    )


@query("circuit_finals", """
SELECT 'wpt-' || year(o_orderdate) || '-malaga-open-' || o_custkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender,
  arg_max('W ' || o_orderkey || '/V ' || o_orderkey, o_orderkey) AS winners,
  arg_max(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'p' || o_orderkey || 'W,p' || o_orderkey || 'V' END, o_orderkey) AS ids, '6-4 7-5' AS sets FROM orders GROUP BY 1, 2""")
def circuit_finals(fx):
    f = nm.circuit_finals(circuit_raw(fx), "WPT")[1]
    return f.select("key", "gender", F.concat_ws("/", "winners").alias("winners"), F.concat_ws(",", "winner_ids").alias("ids"),
                    F.concat_ws(" ", F.transform("sets", lambda x: F.concat_ws("-", x["a"], x["b"]))).alias("sets"))


@query("circuit_tournaments", """
SELECT 'wpt-' || year(o_orderdate) || '-malaga-open-' || o_custkey AS key, 'Málaga Open ' || o_custkey AS name, 'Málaga' AS city,
  strftime(arg_min(CASE WHEN o_orderkey % 7 = 0 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(o_orderdate AS DATE) END, o_orderkey), '%Y-%m-%d') AS start
FROM orders GROUP BY year(o_orderdate), o_custkey""")
def circuit_tournaments(fx):
    return nm.circuit_finals(circuit_raw(fx), "WPT")[0].select("key", "name", "city", d("start"))


# --- articles ----------------------------------------------------------------------------------------------
cte("fx_articles", """
SELECT doc_id AS article_id, DATE '1995-01-01' + CAST(doc_id % 2400 AS INT) AS date, source || CASE WHEN doc_id % 3 = 0 THEN ' finale' ELSE '' END AS title,
  text || CASE WHEN doc_id % 2 = 0 THEN ' 6-4' ELSE '' END AS text FROM documents""")
cte("fx_events", """
SELECT 'e-' || item_id AS key, DATE '1995-01-01' + CAST(item_id * 7 % 2400 AS INT) AS start, string_split(text, ' ')[1] AS city FROM benchmark""")


def articles(fx):
    k = F.col("doc_id")
    return fx.table("documents").select(
        k.alias("article_id"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 2400).cast("int")).alias("date"),
        F.concat("source", F.when(k % 3 == 0, " finale").otherwise("")).alias("title"), F.concat("text", F.when(k % 2 == 0, " 6-4").otherwise("")).alias("text"),
    )


def article_events(fx):
    i = F.col("item_id")
    return fx.table("benchmark").select(
        F.concat(F.lit("e-"), s(i)).alias("key"), F.date_add(F.lit("1995-01-01").cast("date"), (i * 7 % 2400).cast("int")).alias("start"), F.split("text", " ")[0].alias("city")
    )


@query("discover_articles", """
SELECT DISTINCT e.key, a.article_id FROM fx_events e JOIN fx_articles a ON a.date BETWEEN e.start - 8 AND e.start + 18
WHERE contains(strip_accents(lower(a.title || ' ' || a.text)), strip_accents(lower(e.city))) AND regexp_matches(a.text, '\\d[/-]\\d')
  AND regexp_matches(a.title || ' ' || a.text, '(?i)demi|1/2|1/4|1/8|quart|huitiem|finale?|master|open|challenger|tour|resultat')""", ("fx_events", "fx_articles"))
def discover_articles(fx):
    return ln.discover_articles(article_events(fx), articles(fx))


def extracted(fx):
    k = F.col("o_orderkey")
    rows = fx.table("orders").select(
        k.alias("ordinal"), F.when(k % 13 == 0, "unknown").otherwise(F.concat(F.lit("k-"), s(F.col("o_custkey")))).alias("key"),
        F.when(F.col("o_custkey") % 2 == 0, "Men").otherwise("Women").alias("gender"), pick(k % 3, "Final", "Semifinal", "Quarterfinal").alias("round"),
        F.when(k % 17 == 0, F.array(F.lit("Ana"))).otherwise(F.when(k % 2 == 0, F.array(F.lit("Ána"), F.lit("Bea"))).otherwise(F.array(F.lit("bea"), F.lit("ana")))).alias("winners"),
        F.array(F.lit("Eva"), F.lit("Zoe")).alias("losers"), F.when(k % 19 == 0, "none").otherwise(F.when(k % 4 == 0, "6-4 6-4").otherwise("6-4")).alias("score"),
        pick(k % 4, "low", "medium", "high", None).alias("confidence"),
    )
    return rows.withColumn("sets", parse_sets(F.col("score"), "news"))


def known_keys(fx):
    return fx.table("customer").select(F.concat(F.lit("k-"), s(F.col("c_custkey"))).alias("key"))


cte("fx_extracted", """
SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown key' WHEN o_orderkey % 17 = 0 THEN 'bad pair' WHEN o_orderkey % 19 = 0 THEN 'no score' END AS reason,
  'k-' || o_custkey AS key, CASE WHEN o_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender, ['Final','Semifinal','Quarterfinal'][o_orderkey % 3 + 1] AS round,
  ([1, 2, 3, 1][o_orderkey % 4 + 1]) * 10 + CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS quality FROM orders""")


@query("valid_rounds", "SELECT ordinal FROM fx_extracted WHERE reason IS NULL", ("fx_extracted",))
def valid_rounds(fx):
    return fl.valid_rounds(extracted(fx), known_keys(fx))[0].select("ordinal")


@query("dropped_rounds", "SELECT reason, count(*) AS n FROM fx_extracted WHERE reason IS NOT NULL GROUP BY 1", ("fx_extracted",))
def dropped_rounds(fx):
    return fl.valid_rounds(extracted(fx), known_keys(fx))[1]


@query("best_extraction", """
SELECT key, gender, round, quality, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY key, gender, round ORDER BY quality DESC, ordinal) AS rn FROM fx_extracted WHERE reason IS NULL) WHERE rn = 1""", ("fx_extracted",))
def best_extraction(fx):
    good = fl.valid_rounds(extracted(fx), known_keys(fx))[0]
    return ln.best_extraction(good).select("key", "gender", "round", long("quality"), "ordinal")


@query("finals_cross_check", """
SELECT key, gender, CAST(substr(key, 3) AS BIGINT) % 3 <> 0 AS agrees FROM fx_extracted WHERE reason IS NULL AND round = 'Final'""", ("fx_extracted",))
def finals_cross_check(fx):
    ck = F.col("c_custkey")
    finals = fx.table("customer").select(
        F.concat(F.lit("k-"), s(ck)).alias("key"), F.when(ck % 2 == 0, "Men").otherwise("Women").alias("gender"),
        F.when(ck % 3 == 0, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array(F.lit("BEA"), F.lit("Ana "))).alias("winners"),
    )
    good = fl.valid_rounds(extracted(fx), known_keys(fx))[0]
    return ln.cross_check(good, finals).select("key", "gender", "agrees")


# --- draws ----------------------------------------------------------------------------------------------------
cte("fx_draw_cells", """
WITH b AS (SELECT c_custkey AS ck, '/wpt/2015/marzo/c' || c_custkey || '/' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender FROM customer),
f AS (SELECT b.*, j, 2 * j + (ck + j) % 2 AS p FROM b CROSS JOIN range(4) t(j)),
g AS (SELECT a.ck, a.path, a.gender, a.j // 2 AS j, CASE WHEN (a.ck + a.j // 2) % 3 = 0 THEN a.p ELSE c.p END AS p FROM f a JOIN f c ON a.ck = c.ck AND c.j = a.j + 1 WHERE a.j % 2 = 0)
SELECT path, gender, ck, 0 AS r, c, ['Cuartos', 'Semifinales', 'Final'][c + 1] AS text, FALSE AS is_name, NULL AS p FROM b CROSS JOIN range(3) t(c)
UNION ALL SELECT path, gender, ck, 1 + 2 * p, 0, 'Ana P' || ck || 'x' || p || ' Bea Q' || ck || 'x' || p || ' (esp-arg)', TRUE, p FROM b CROSS JOIN range(8) t(p)
UNION ALL SELECT path, gender, ck, 2 + 4 * j, 1, 'Ana P' || ck || 'x' || p || ' Bea Q' || ck || 'x' || p || ' (esp-arg)', TRUE, p FROM f
UNION ALL SELECT path, gender, ck, 3 + 4 * j, 1, '6/4 6/' || ((ck + j) % 5), FALSE, NULL FROM f
UNION ALL SELECT path, gender, ck, 4 + 8 * j, 2, 'Ana P' || ck || 'x' || p || ' Bea Q' || ck || 'x' || p || ' (esp-arg)', TRUE, p FROM g
UNION ALL SELECT path, gender, ck, 5 + 8 * j, 2, '6/4 6/' || ((ck + j + 4) % 5), FALSE, NULL FROM g""")


@query("draw_page_cells", "SELECT path, gender, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, text, is_name FROM fx_draw_cells", ("fx_draw_cells",))
def draw_page_cells(fx):
    cells = draw_cells(fx.draw_pages, path="path").where("text <> ''")
    return cells.select("path", "gender", long("r"), long("c"), "text", "is_name")


@query("draw_page_forms", """
SELECT path, gender, CAST(r AS BIGINT) AS r, CAST(c + CASE ck % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS c, text, is_name
FROM fx_draw_cells""", ("fx_draw_cells",))
def draw_page_forms(fx):
    """The brackets as pages of four forms, by customer: plain, pairs marked by their colour alone after cells two columns
    wide, a first cell as tall as the table beside a table without pairs, and pairs in tables of their own inside their cells."""
    pair, begin = '<td bgcolor="#000000" class="primera">', "<table border=0><tr>"
    form, html = F.regexp_extract("path", r"/c(\d+)/", 1).cast("long") % 4, F.col("html")
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    colour = swap(swap(html, pair, '<td bgcolor="#000000">'), "<tr>", '<tr><td colspan="2"></td>')
    tall = swap(html, begin, '<table><tr><td>Final</td><td>Semifinales</td></tr></table><table border=0><tr><td rowspan="16"></td>')
    nested = F.regexp_replace(html, f"({pair})(.*?)</td>", "$1<table><tr><td>$2</td></tr></table></td>")
    page = F.when(form == 1, colour).when(form == 2, tall).when(form == 3, nested).otherwise(html)
    cells = draw_cells(fx.draw_pages.withColumn("html", page), path="path").where("text <> ''")
    return cells.select("path", "gender", long("r"), long("c"), "text", "is_name")


@query("classified_cells", """
SELECT path, gender, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CASE WHEN is_name THEN 'name' ELSE 'score' END AS kind, ['Quarterfinal', 'Semifinal', 'Final'][c + 1] AS round,
  CASE WHEN is_name THEN 'Ana P' || ck || 'x' || p || '/Bea Q' || ck || 'x' || p END AS players FROM fx_draw_cells WHERE r > 0""", ("fx_draw_cells",))
def classified_cells(fx):
    c = ln.classify_cells(fx.draw_cells)
    return c.select("path", "gender", long("r"), long("c"), "kind", "round", F.when(F.col("kind") == "name", F.concat_ws("/", "players")).alias("players"))


cte("fx_draw_results", """
SELECT q.path, q.gender, ['Quarterfinal', 'Semifinal'][q.c + 1] AS round, q.ck, q.n, q.p AS a, q.p2 AS b, CASE WHEN w.p = q.p THEN q.p ELSE q.p2 END AS w, CASE WHEN w.p = q.p THEN q.p2 ELSE q.p END AS l,
  CASE WHEN w.p = q.p THEN q.r2 ELSE q.r1 END AS lr, q.r1, q.r2, q.c FROM (
  SELECT path, gender, ck, c, p, r AS r1, lead(p) OVER w AS p2, lead(r) OVER w AS r2, row_number() OVER w AS n FROM fx_draw_cells WHERE is_name AND c < 2
  WINDOW w AS (PARTITION BY path, c ORDER BY r)) q
JOIN fx_draw_cells w ON w.path = q.path AND w.is_name AND w.c = q.c + 1 AND w.p IN (q.p, q.p2) WHERE q.n % 2 = 1""", ("fx_draw_cells",))


@query("draw_results", """
SELECT path, gender, round, 'Ana P' || ck || 'x' || w || '/Bea Q' || ck || 'x' || w AS winners, 'Ana P' || ck || 'x' || l || '/Bea Q' || ck || 'x' || l AS losers,
  replace((SELECT arg_min(s.text, abs(s.r - lr) * 1000 + s.c * 100 + s.r) FROM fx_draw_cells s WHERE s.path = m.path AND s.r > 0 AND NOT s.is_name AND s.c IN (m.c, m.c + 1) AND s.r BETWEEN m.r1 - 1 AND m.r2 + 2), '/', '-') AS score
FROM fx_draw_results m""", ("fx_draw_results", "fx_draw_cells"))
def draw_results(fx):
    r = ln.draw_results(ln.classify_cells(fx.draw_cells))
    return r.select("path", "gender", "round", F.concat_ws("/", "winners").alias("winners"), F.concat_ws("/", "losers").alias("losers"), "score")


def gate_inputs(fx):
    rounds = ln.draw_results(ln.classify_cells(fx.draw_cells)).withColumn("ordinal", F.col("c") * 100 + F.col("match_no"))
    ck = F.col("c_custkey")
    base = fx.table("customer").select(F.concat(F.lit("/wpt/2015/marzo/c"), s(ck), F.lit("/")).alias("path"), F.concat(F.lit("t-"), s(ck)).alias("key"))
    winner = lambda j: draw_pair(ck, second_winner(ck, F.lit(j)))
    finals = fx.table("customer").select(
        F.concat(F.lit("t-"), s(ck)).alias("key"), F.when(ck % 2 == 0, "Men").otherwise("Women").alias("gender"), winner(0).alias("winners"),
        F.when(ck % 3 == 0, F.array(F.lit("Zoe Wrong"), F.lit("Eva Wrong"))).otherwise(F.reverse(winner(1))).alias("runners_up"),
    )
    return rounds, base, finals


@query("accuracy_gate", """
SELECT '/wpt/2015/marzo/c' || c_custkey || '/' AS path, 't-' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS hits, CASE WHEN c_custkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM customer""")
def accuracy_gate(fx):
    return ln.accuracy_gate(*gate_inputs(fx)).select("path", "key", long("hits"), "verdict")


@query("accuracy_rate", """
SELECT count(*) AS checked, count(*) FILTER (c_custkey % 3 <> 0) AS agree, CAST(count(*) FILTER (c_custkey % 3 <> 0) AS DOUBLE) / count(*) AS rate FROM customer""")
def accuracy_rate(fx):
    return ln.gate_rate(ln.accuracy_gate(*gate_inputs(fx)))


@query("new_rounds", """
SELECT 't-' || ck AS key, gender, round, 'Ana P' || ck || 'x' || w AS first_winner FROM fx_draw_results WHERE ck % 3 <> 0 AND NOT (ck % 5 = 0 AND round = 'Semifinal')""", ("fx_draw_results",))
def new_rounds(fx):
    rounds, pairs, finals = gate_inputs(fx)
    rounds = cut(rounds)                          # read three times
    # every draw's rounds came in twice; a fifth of the semifinals is known from another source already
    ck = F.col("c_custkey")
    known = fx.table("customer").select(ck, F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    won = second_winner(ck, F.col("j"))
    lost = first_winner(ck, 2 * F.col("j")) + first_winner(ck, 2 * F.col("j") + 1) - won
    known = known.select(
        F.concat(F.lit("t-"), s(ck)).alias("key"), F.when(ck % 2 == 0, "Men").otherwise("Women").alias("gender"), F.lit("Semifinal").alias("round"),
        F.reverse(draw_pair(ck, won)).alias("winners"), draw_pair(ck, lost).alias("losers"), F.when(ck % 5 == 0, "news").otherwise("draws").alias("source"),
    )
    out = ln.new_rounds(rounds.unionByName(rounds), pairs, ln.accuracy_gate(rounds, pairs, finals), known)
    return out.select("key", "gender", "round", F.col("winners")[0].alias("first_winner"))


@query("consecutive_pairs", """
SELECT user_id, event_id, (rn - 1) // 2 AS match_no, (rn - 1) % 2 AS slot FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)""")
def consecutive_pairs(fx):
    return sch.pair_rows(fx.table("events").select("user_id", "event_id"), ["user_id"], "event_id").select("user_id", "event_id", long("match_no"), long("slot"))


# draws of the part table: month and city in the path, some without a usable month
def part_draws(fx):
    k = F.col("p_partkey")
    month = pick(k % 5, "enero", "febrero", "marzo", "x", "diciembre")
    city = F.when(k % 4 == 0, F.concat(F.lit("ppt"), F.split("p_name", " ")[1], s(k % 10))).otherwise(F.translate(F.lower("p_brand"), "#", ""))
    return fx.table("part").select(
        F.concat_ws("/", F.lit("/wpt"), s(season(k)), month, city, F.lit("")).alias("p0"), k.alias("ordinal"),
        season(k).alias("year"), F.concat("p_name", F.lit(" Master")).alias("name"),
    ).select(F.concat(F.lit("/"), s(F.col("ordinal")), F.col("p0")).alias("path"), "ordinal", "year", "name")


cte("fx_part_draws", """
SELECT p_partkey AS d_ord, CAST(2000 + p_partkey % 10 + 10 * (p_partkey // 2000) AS INT) AS year, [1, 2, 3, NULL, 12][p_partkey % 5 + 1] AS month,
  CASE WHEN p_partkey % 4 = 0 THEN 'ppt' || string_split(p_name, ' ')[2] || (p_partkey % 10) ELSE lower(replace(p_brand, '#', '')) END AS dc,
  CASE WHEN p_partkey % 4 = 0 THEN string_split(p_name, ' ')[2] ELSE 'brand' END AS dw, string_split(p_name, ' ') AS dt FROM part""")
cte("fx_part_t", """
SELECT key, ordinal AS t_ord, year, lower(replace(coalesce(city, ''), '#', '')) AS tc, replace(name, ' ', '') AS tn, string_split(name, ' ') AS tt,
  CASE WHEN start IS NOT NULL AND strftime(start, '%m-%d') <> '01-01' THEN month(start) END AS t_month FROM fx_archive_names""", ("fx_archive_names",))


_SCORES = """
WITH o AS (
  SELECT a.dt, b.tt, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE CAST(c AS DOUBLE) / least(na, nb) END AS ov FROM (SELECT DISTINCT dt, (CASE WHEN length(dt[1]) > 3 THEN 1 ELSE 0 END + CASE WHEN length(dt[2]) > 3 THEN 1 ELSE 0 END) AS na FROM fx_part_draws) a
  CROSS JOIN (SELECT DISTINCT tt, (CASE WHEN length(tt[1]) > 3 THEN 1 ELSE 0 END + CASE WHEN length(tt[2]) > 3 THEN 1 ELSE 0 END) AS nb FROM fx_part_t) b
  CROSS JOIN LATERAL (SELECT CASE WHEN length(a.dt[1]) > 3 AND a.dt[1] IN (b.tt[1], b.tt[2]) THEN 1 ELSE 0 END + CASE WHEN length(a.dt[2]) > 3 AND a.dt[2] IN (b.tt[1], b.tt[2]) THEN 1 ELSE 0 END AS c) x),
p AS (SELECT d.d_ord, t.key, CASE WHEN t.tc = '' THEN 0 WHEN contains(t.tc, d.dc) OR contains(d.dc, t.tc) THEN 3 WHEN substr(t.tc, 1, 5) = substr(d.dc, 1, 5) THEN 2.5 ELSE 0 END AS c,
  3 * o.ov AS v, CASE WHEN length(d.dw) > 3 AND contains(t.tn, d.dw) THEN 3 ELSE 0 END AS w,
  CASE WHEN d.month IS NULL OR t.t_month IS NULL THEN 0 ELSE CASE least(abs(d.month - t.t_month), 12 - abs(d.month - t.t_month)) WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE -3 END END AS m
  FROM fx_part_draws d JOIN fx_part_t t ON t.year = d.year JOIN o ON o.dt = d.dt AND o.tt = t.tt)
SELECT d_ord, key, round(c + v + w + m, 6) AS score FROM p WHERE c + v + w + m >= 3 AND c + v + w > 0"""


@query("score_draws", _SCORES, ("fx_part_draws", "fx_part_t"))
def score_draws(fx):
    return ln.score_draws(part_draws(fx), fx.archive_names).select("d_ord", "key", F.round("score", 6).alias("score"))


#: Best-first assignment by recursion: of the edges left, those that lead both of their ends are taken, with all edges of these ends.
_ASSIGNED = """
WITH RECURSIVE edges AS ({edges}),
g(n, d_ord, key, t_ord, score, taken) AS (
  SELECT 0, d_ord, key, t_ord, score, false FROM edges JOIN fx_part_t USING (key)
  UNION ALL
  SELECT n + 1, d_ord, key, t_ord, score, first_d = t_ord AND first_t = d_ord FROM (
    SELECT n, d_ord, key, t_ord, score, first_value(t_ord) OVER (PARTITION BY d_ord ORDER BY score DESC, t_ord) AS first_d,
      first_value(d_ord) OVER (PARTITION BY t_ord ORDER BY score DESC, d_ord) AS first_t
    FROM (SELECT *, bool_or(taken) OVER (PARTITION BY d_ord) AS d_gone, bool_or(taken) OVER (PARTITION BY t_ord) AS t_gone FROM g)
    WHERE NOT d_gone AND NOT t_gone)),
pairs AS (SELECT d_ord, key, score FROM g WHERE taken),
named AS (SELECT '/' || p_partkey || '/wpt/' || (2000 + p_partkey % 10 + 10 * (p_partkey // 2000)) || '/' || ['enero', 'febrero', 'marzo', 'x', 'diciembre'][p_partkey % 5 + 1] || '/' ||
  CASE WHEN p_partkey % 4 = 0 THEN 'ppt' || string_split(p_name, ' ')[2] || (p_partkey % 10) ELSE lower(replace(p_brand, '#', '')) END || '/' AS path,
  p_partkey AS d_ord, p_name || ' Master' AS name FROM part)
"""
_ALL_EDGES = _SCORES.replace(" AND c + v + w > 0", "")


@query("assign_draws", _ASSIGNED.format(edges=_ALL_EDGES) + "SELECT path, key, score FROM pairs JOIN named USING (d_ord)", ("fx_part_draws", "fx_part_t"))
def assign_draws(fx):
    return ln.assign_draws(part_draws(fx), fx.archive_names)[0]


@query("unmatched_draws", _ASSIGNED.format(edges=_ALL_EDGES) + "SELECT path, name FROM named WHERE d_ord NOT IN (SELECT d_ord FROM pairs)", ("fx_part_draws", "fx_part_t"))
def unmatched_draws(fx):
    return ln.assign_draws(part_draws(fx), fx.archive_names)[1].select("path", "name")
