"""Transitions, follows, notifications and health over derived snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions.text import follow_key, surname
from courtside.operators import alerts as a, enrich as en
from courtside.plans.fixtures import today
from courtside.plans.registry import cte, query

SNAP = ("fx_snapshots",)
day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
DAY2, DAY3 = "2024-01-10", "2024-01-11"


def one_day(fx, d):
    return fx.snapshots.where(F.col("snapshot_at") == F.lit(d).cast("timestamp_ntz"))


_LIVE = "SELECT id FROM fx_snapshots WHERE status = 'live' AND snapshot_at = TIMESTAMP '{0}'"
_SOON = """SELECT id FROM fx_snapshots WHERE status = 'upcoming' AND snapshot_at = TIMESTAMP '{0}'
  AND est_start_at > snapshot_at AND est_start_at <= snapshot_at + INTERVAL 20 MINUTE"""


@query("newly_live", f"{_LIVE.format(DAY3)} EXCEPT {_LIVE.format(DAY2)}", SNAP)
def newly_live(fx):
    return a.newly_live(one_day(fx, DAY2), one_day(fx, DAY3)).select("id")


@query("newly_soon", f"{_SOON.format(DAY3)} EXCEPT {_SOON.format(DAY2)}", SNAP)
def newly_soon(fx):
    return a.newly_soon(one_day(fx, DAY2), one_day(fx, DAY3)).select("id")


_STEPS = "SELECT snapshot_at, lag(snapshot_at) OVER (ORDER BY snapshot_at) AS prev_at FROM (SELECT DISTINCT snapshot_at FROM fx_snapshots)"
_TRANS = """
WITH steps AS ({steps}), hit AS (SELECT * FROM fx_snapshots WHERE {cond})
SELECT strftime(h.snapshot_at, '%Y-%m-%d') AS snapshot_at, h.id FROM hit h JOIN steps s USING (snapshot_at)
WHERE NOT EXISTS (SELECT 1 FROM hit p WHERE p.snapshot_at = s.prev_at AND p.id = h.id)"""
LIVE_TRANSITIONS = _TRANS.format(steps=_STEPS, cond="status = 'live'")


@query("live_transitions", LIVE_TRANSITIONS, SNAP)
def live_transitions(fx):
    return a.live_transitions(fx.snapshots).select(day("snapshot_at"), "id")


SOON_TRANSITIONS = _TRANS.format(
    steps=_STEPS, cond="status = 'upcoming' AND est_start_at > snapshot_at AND est_start_at <= snapshot_at + INTERVAL 20 MINUTE")


@query("soon_transitions", SOON_TRANSITIONS, SNAP)
def soon_transitions(fx):
    return a.soon_transitions(fx.snapshots).select(day("snapshot_at"), "id")


SCORE_CHANGES = """
SELECT id, ordinal FROM (SELECT user_id AS id, event_id AS ordinal, sig, lag(sig) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM (
  SELECT *, CAST(floor(value) AS BIGINT) % 3 || '|' || CASE event_type WHEN 'click' THEN 'live' WHEN 'purchase' THEN 'final' ELSE 'upcoming' END AS sig
  FROM events WHERE event_type <> 'error')) WHERE prev IS NOT NULL AND prev <> sig"""


def polls(fx):
    sig = F.concat((F.floor("value") % 3).cast("string"), F.lit("|"), F.col("status"))
    return fx.events.where("event_type <> 'error'").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("ts").alias("snapshot_at"), sig.alias("signature")
    )


@query("score_changes", SCORE_CHANGES)
def score_changes(fx):
    return a.score_changes(polls(fx), ["ordinal"]).select("id", "ordinal")


# --- follows -----------------------------------------------------------------------------------
cte("fx_follow_hits", """
SELECT DISTINCT c.c_custkey AS endpoint, f.id, f.ordinal FROM customer c CROSS JOIN (SELECT count(*) AS n FROM supplier)
JOIN fx_feed f ON (f.source = 'fip' AND f.ck = c.c_custkey + 1)
WHERE c.c_custkey % 50 <> 49
UNION
SELECT c.c_custkey, t.id, t.ordinal FROM customer c CROSS JOIN (SELECT count(*) AS n FROM supplier)
JOIN (SELECT DISTINCT s AS needle, id, ordinal FROM (SELECT DISTINCT 'p' || s_suppkey AS s FROM supplier)
      JOIN fx_feed ON contains(lower(p0 || ' / ' || p1), s) OR contains(lower(p2 || ' / ' || p3), s)) t ON t.needle = 'p' || (c.c_custkey % n)
WHERE c.c_custkey % 50 <> 49 AND length(t.needle) >= 3""", ("fx_feed",))


def of_status(fx, status: str):
    return fx.feed.where(F.col("status") == status)


@query("match_follows", "SELECT endpoint, id FROM fx_follow_hits", ("fx_follow_hits",))
def match_follows(fx):
    return a.match_follows(fx.feed, a.follow_rows(fx.subscriptions)).select("endpoint", "id")


_OPEN = """SELECT endpoint, id, status, row_number() OVER (PARTITION BY endpoint ORDER BY CASE status WHEN 'live' THEN 0 ELSE 1 END, h.ordinal, id) AS rn
FROM fx_follow_hits h JOIN fx_feed USING (id) WHERE status <> 'final'"""


@query("followed_open", _OPEN, ("fx_follow_hits", "fx_feed"))
def followed_open(fx):
    return a.followed_open(fx.feed, a.follow_rows(fx.subscriptions)).withColumn("rn", F.col("rn").cast("long"))


@query("followed_open_first", f"SELECT * FROM ({_OPEN}) WHERE rn <= 40", ("fx_follow_hits", "fx_feed"))
def followed_open_first(fx):
    return a.followed_open(fx.feed, a.follow_rows(fx.subscriptions), shown=40).withColumn("rn", F.col("rn").cast("long"))


@query("follow_rows", """
SELECT c_custkey AS endpoint, 'player' AS kind, CAST(c_custkey % n AS VARCHAR) AS key, 'Player P' || (c_custkey % n) AS name FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) WHERE c_custkey % 50 <> 49
UNION ALL SELECT c_custkey, 'tournament', 'fip:' || (c_custkey + 1), 'T' FROM customer WHERE c_custkey % 50 <> 49""")
def follow_rows(fx):
    return a.follow_rows(fx.subscriptions)


_TEAMS = "l.p0 || ' / ' || l.p1 || ' vs ' || l.p2 || ' / ' || l.p3"


def _messages(status, one, many, detail, text):
    return f"""
SELECT endpoint, n, CASE WHEN n = 1 THEN '{one}' || line ELSE '{many[0]}' || n || '{many[1]}' END AS title, CASE WHEN n = 1 THEN detail ELSE body END AS body FROM (
  SELECT endpoint, count(*) AS n, min(line) FILTER (rn = 1) AS line, min(detail) FILTER (rn = 1) AS detail, string_agg(txt, chr(10) ORDER BY rn) FILTER (rn <= 5) AS body FROM (
    SELECT endpoint, {_TEAMS} AS line, {detail} AS detail, {text} AS txt, row_number() OVER (PARTITION BY endpoint ORDER BY h.ordinal, h.id) AS rn
    FROM fx_follow_hits h JOIN fx_feed l ON l.id = h.id WHERE l.status = '{status}') GROUP BY 1)"""


@query("live_notifications", _messages("live", "🔴 Live: ", ("🔴 ", " of your follows are live"), "l.tname || ' · ' || l.round", _TEAMS), ("fx_follow_hits", "fx_feed"))
def live_notifications(fx):
    return a.notifications(of_status(fx, "live"), a.follow_rows(fx.subscriptions), "live")


_WHEN = "coalesce('~' || l.est_start, 'soon')"


@query("soon_notifications", _messages(
    "upcoming", "⏱ Starting soon: ", ("⏱ ", " of your follows start soon"), f"l.tname || ' · ' || l.court || ' · ' || {_WHEN}", f"{_TEAMS} || ' (' || {_WHEN} || ')'"), ("fx_follow_hits", "fx_feed"))
def soon_notifications(fx):
    return a.notifications(of_status(fx, "upcoming"), a.follow_rows(fx.subscriptions), "soon")


@query("alert_digest", """
SELECT status, n, 'now live (' || n || ')' || chr(10) || chr(10) || body || CASE WHEN n > 8 THEN chr(10) || chr(10) || '…and ' || (n - 8) || ' more' ELSE '' END AS text FROM (
  SELECT status, count(*) AS n, string_agg(line, chr(10) || chr(10) ORDER BY rn) FILTER (rn <= 8) AS body FROM (
    SELECT status, CASE WHEN federation = 'FIP' THEN 'FIP International' ELSE federation END || ': ' || p0 || ' / ' || p1 || '  vs  ' || p2 || ' / ' || p3 || chr(10) || tname || ' · ' || round || ' · ' || court AS line,
      row_number() OVER (PARTITION BY status ORDER BY ordinal, id) AS rn FROM fx_feed) GROUP BY 1)""", ("fx_feed",))
def alert_digest(fx):
    return a.digest(fx.feed, "now live", ["status"])


_REGION = "CASE WHEN federation = 'FIP' THEN 'FIP International' ELSE federation END"


@query("soon_digest", f"""
SELECT source, n, 'starting soon (' || n || ')' || chr(10) || chr(10) || body || CASE WHEN n > 8 THEN chr(10) || chr(10) || '…and ' || (n - 8) || ' more' ELSE '' END AS text FROM (
  SELECT source, count(*) AS n, string_agg(line, chr(10) || chr(10) ORDER BY rn) FILTER (rn <= 8) AS body FROM (
    SELECT source, {_REGION} || ' (' || coalesce('~' || est_start, 'soon') || '): ' || p0 || ' / ' || p1 || '  vs  ' || p2 || ' / ' || p3 || chr(10) || court || ' · ' || round || ' · ' || tname AS line,
      row_number() OVER (PARTITION BY source ORDER BY ordinal, id) AS rn FROM fx_feed WHERE status = 'upcoming') GROUP BY 1)""", ("fx_feed",))
def soon_digest(fx):
    return a.digest(of_status(fx, "upcoming"), "starting soon", ["source"], kind="soon")


@query("surname_and_follow_key", """
SELECT s_suppkey AS id, lower(s_name) AS surname, CASE WHEN s_suppkey % 3 = 0 THEN 'n:' || s_name WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS follow FROM supplier""")
def surname_and_follow_key(fx):
    k = F.col("s_suppkey")
    return fx.table("supplier").select(
        k.alias("id"), surname(F.concat(F.lit(" Ana  María "), F.col("s_name"), F.lit(" "))).alias("surname"),
        follow_key(F.when(k % 3 == 1, k), F.when(k % 3 == 0, F.col("s_name"))).alias("follow"),
    )


# --- health ---------------------------------------------------------------------------------------
ST = ("fx_source_status",)
NOW = "2024-01-31 00:30:00"


def now():
    from courtside.plans import alerts as me

    return F.lit(me.NOW).cast("timestamp_ntz")


@query("last_good", """
SELECT ordinal, strftime(max(CASE WHEN ok THEN snapshot_at END) OVER (PARTITION BY source ORDER BY ordinal), '%Y-%m-%d %H:%M:%S') AS last_ok_at FROM fx_source_status""", ST)
def last_good(fx):
    return a.last_good(fx.source_status, ["ordinal"]).select("ordinal", stamp("last_ok_at"))


_LATEST = """SELECT source, arg_max(ok, ordinal) AS ok, arg_max(match_count, ordinal) AS match_count, max(CASE WHEN ok THEN snapshot_at END) AS last_ok_at FROM fx_source_status GROUP BY 1"""


@query("latest_status", f"SELECT source, ok, match_count, strftime(last_ok_at, '%Y-%m-%d %H:%M:%S') AS last_ok_at FROM ({_LATEST})", ST)
def latest_status(fx):
    return a.latest_status(fx.source_status, ["ordinal"]).select("source", "ok", "match_count", stamp("last_ok_at"))


@query("last_good_matches", """
SELECT source, ordinal FROM fx_source_status s WHERE ok AND snapshot_at = (SELECT max(snapshot_at) FROM fx_source_status t WHERE t.ok AND t.source = s.source)""", ST)
def last_good_matches(fx):
    return a.last_good_matches(fx.source_status).select("source", "ordinal")


cte("fx_health_feed", """
SELECT max(ts) AS generated_at, count(*) AS total, count(*) FILTER (event_type = 'nothing') AS rankings FROM events""")
_CHECKS = f"""
SELECT 'fresh' AS name, date_diff('microsecond', generated_at, TIMESTAMP '{NOW}') / 60e6 <= 60 AS ok, TRUE AS critical FROM fx_health_feed
UNION ALL SELECT 'volume', total > 0, TRUE FROM fx_health_feed UNION ALL SELECT 'rankings', rankings > 0, FALSE FROM fx_health_feed
UNION ALL SELECT 'src:' || source, ok, NOT ok AND coalesce(date_diff('microsecond', last_ok_at, TIMESTAMP '{NOW}') / 3600e6 > 3, FALSE) FROM ({_LATEST})"""


def health(fx):
    feed = fx.table("events").agg(
        F.max("ts").alias("generated_at"), F.count("*").alias("total"), F.count_if(F.col("event_type") == "nothing").alias("rankings")
    )
    return a.health(a.latest_status(fx.source_status, ["ordinal"]), feed, now())


@query("health_checks", _CHECKS, ("fx_health_feed", "fx_source_status"))
def health_checks(fx):
    return health(fx)[0]


@query("health_verdict", f"""
SELECT CASE WHEN bool_or(NOT ok AND critical) THEN 'down' WHEN bool_or(NOT ok) THEN 'warn' ELSE 'ok' END AS overall FROM ({_CHECKS})""", ("fx_health_feed", "fx_source_status"))
def health_verdict(fx):
    return health(fx)[1]


@query("alert_ownership", f"""
SELECT NOT (producer <> 'src1' AND age < 10) AS owns_alerts, producer <> 'src1' AND age < 35 AS standby FROM (
  SELECT 'src' || arg_max(user_id % 2, ts) AS producer, date_diff('microsecond', max(ts), TIMESTAMP '{NOW}') / 60e6 AS age FROM events)""")
def alert_ownership(fx):
    snaps = fx.table("events").select(
        F.col("ts").alias("snapshot_at"), F.concat(F.lit("src"), (F.col("user_id") % 2).cast("string")).alias("producer")
    )
    return a.owns_alerts(snaps, now(), "src1")


# --- enrichment ---------------------------------------------------------------------------------------
cte("fx_club_cache", """
SELECT CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '' END || c_custkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN 'Club ' || c_custkey END AS club,
  DATE '1998-06-15' - CAST(c_custkey % 12 AS INT) AS looked_up FROM customer""")


def club_cache(fx):
    ck = F.col("c_custkey")
    club = F.when(ck % 3 == 0, F.struct(F.concat(F.lit("Club "), ck.cast("string")).alias("name"), F.concat(F.lit("/c/"), ck.cast("string")).alias("url")))
    return fx.table("customer").select(
        F.concat(F.when(ck % 4 == 0, "x").otherwise(""), ck.cast("string")).alias("event_id"), club.alias("organiser"), F.date_add(today(), -(ck % 12).cast("int")).cast("timestamp_ntz").alias("looked_up_at")
    )


def club_rows(fx):
    return fx.feed.select("id", F.col("tournament.id").alias("event_id"))


_FRESH = "(club IS NOT NULL OR looked_up > DATE '1998-06-15' - 7)"


@query("organiser_lookup", f"""
SELECT f.id, c.club AS organiser FROM fx_feed f LEFT JOIN fx_club_cache c ON c.event_id = f.tid AND {_FRESH}""", ("fx_feed", "fx_club_cache"))
def organiser_lookup(fx):
    out, _ = en.enrich_ttl(club_rows(fx), club_cache(fx), today().cast("timestamp_ntz"))
    return out.select("id", F.col("organiser.name").alias("organiser"))


@query("organiser_refresh_keys", f"""
SELECT DISTINCT tid AS event_id FROM fx_feed WHERE tid NOT IN (SELECT event_id FROM fx_club_cache WHERE {_FRESH})""", ("fx_feed", "fx_club_cache"))
def organiser_refresh_keys(fx):
    return en.enrich_ttl(club_rows(fx), club_cache(fx), today().cast("timestamp_ntz"))[1]


def backfill_inputs(fx):
    o = F.col("ordinal")
    none = F.lit(None).cast("string")
    t = fx.archive_index.select(
        "key", F.when(o % 5 == 0, "Street 1").alias("address"), none.alias("venue"), none.alias("organizer"),
        F.when(o % 7 == 0, "/x").alias("organizer_url"), F.when(o % 11 == 0, True).alias("no_organizer"),
    )
    info = fx.archive_index.select(
        "key", ((o % 13 != 0) & (o % 17 != 0)).alias("ok"), F.when(o % 2 == 0, F.concat(F.lit(" Road "), o.cast("string"))).alias("address"),
        F.when(o % 3 == 0, "").alias("location_name"), F.when(o % 4 == 0, "Hall").alias("club_name"),
        (o % 2 == 0).alias("connected"), F.when(o % 4 == 0, "/club").alias("club_path"),
    )
    return t, info


_BF = "CASE WHEN {done} THEN 'skipped' WHEN ordinal % 13 = 0 OR ordinal % 17 = 0 THEN 'failed' WHEN {none} THEN '{label}' ELSE 'filled' END"
_LOC = _BF.format(done="ordinal % 5 = 0", none="ordinal % 2 <> 0 AND ordinal % 4 <> 0", label="nodata")
_ORG = _BF.format(done="ordinal % 7 = 0 OR ordinal % 11 = 0", none="ordinal % 4 <> 0", label="noclub")


@query("backfill_locations", f"""
SELECT key, outcome, CASE WHEN ordinal % 5 = 0 THEN 'Street 1' WHEN outcome = 'filled' AND ordinal % 2 = 0 THEN 'Road ' || ordinal END AS address,
  CASE WHEN outcome = 'filled' AND ordinal % 4 = 0 THEN 'Hall' END AS venue FROM (SELECT *, {_LOC} AS outcome FROM fx_archive_index)""", ("fx_archive_index",))
def backfill_locations(fx):
    return en.backfill_locations(*backfill_inputs(fx))[0].select("key", "outcome", "address", "venue")


@query("backfill_locations_report", f"SELECT {_LOC} AS outcome, count(*) AS n FROM fx_archive_index GROUP BY 1", ("fx_archive_index",))
def backfill_locations_report(fx):
    return en.backfill_locations(*backfill_inputs(fx))[1]


@query("backfill_organisers", f"""
SELECT key, outcome, CASE WHEN outcome = 'filled' THEN '/club' WHEN ordinal % 7 = 0 THEN '/x' END AS organizer_url,
  CASE WHEN outcome = 'noclub' OR ordinal % 11 = 0 THEN TRUE END AS no_organizer FROM (SELECT *, {_ORG} AS outcome FROM fx_archive_index)""", ("fx_archive_index",))
def backfill_organisers(fx):
    return en.backfill_organisers(*backfill_inputs(fx))[0].select("key", "outcome", "organizer_url", "no_organizer")
