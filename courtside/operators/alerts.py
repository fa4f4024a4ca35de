"""Transitions between snapshots, follows, notification texts, source health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.functions import lookups as lk
from courtside.functions.labels import region_label, status_order
from courtside.functions.text import surname
from courtside.operators.contains import contains_pairs
from courtside.operators.feed import tournament_key
from courtside.operators.ordered import first_rows, last_known, time_slice
from courtside.operators.skew import grid_join, placed_join
from courtside.schema import FOLLOWS
from courtside.session import cut, forget, shuffles_removed, spread, stored


# --- transitions -----------------------------------------------------------------------

def newly_live(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Live now and not live in the previous snapshot."""
    return cur.where(F.col("status") == lk.LIVE).join(
        prev.where(F.col("status") == lk.LIVE).select("id"), "id", "left_anti"
    )


def within_lead(est: Column, at: Column, lead_minutes: int = lk.LEAD_MINUTES) -> Column:
    """The estimate lies ahead of the clock by at most the lead."""
    return F.coalesce((est > at) & (est <= at + F.make_dt_interval(mins=F.lit(lead_minutes))), F.lit(False))


def newly_soon(prev: DataFrame, cur: DataFrame, lead_minutes: int = lk.LEAD_MINUTES) -> DataFrame:
    """Upcoming matches that entered the lead window since the previous snapshot.

    Both inputs carry the clock of their snapshot as `snapshot_at`.
    """
    soon = lambda df: df.where(
        (F.col("status") == lk.UPCOMING) & within_lead(F.col("est_start_at"), F.col("snapshot_at"), lead_minutes)
    )
    return soon(cur).join(soon(prev).select("id"), "id", "left_anti")


def snapshot_steps(rows: DataFrame) -> DataFrame:
    """Each snapshot with the one before it (a table of snapshots, not of matches)."""
    return rows.select("snapshot_at").distinct().withColumn(
        "prev_at", F.lag("snapshot_at").over(Window.orderBy("snapshot_at"))
    )


def transitions(rows: DataFrame, hit: Column) -> DataFrame:
    """Rows of a snapshot history for which `hit` holds and did not hold one snapshot earlier."""
    on = rows.where(hit)
    before = on.select(F.col("snapshot_at").alias("prev_at"), "id")
    return on.join(snapshot_steps(rows), "snapshot_at").join(before, ["prev_at", "id"], "left_anti")


def live_transitions(rows: DataFrame) -> DataFrame:
    """Every change to live in a history; a match that leaves and comes back counts again."""
    return transitions(rows, F.col("status") == lk.LIVE)


def soon_transitions(rows: DataFrame, lead_minutes: int = lk.LEAD_MINUTES) -> DataFrame:
    return transitions(
        rows, (F.col("status") == lk.UPCOMING) & within_lead(F.col("est_start_at"), F.col("snapshot_at"), lead_minutes)
    )


def score_changes(rows: DataFrame, order: list[str], slice_: Column | None = None) -> DataFrame:
    """Rows whose signature differs from the last one seen for the id; first sight is no change."""
    cut = time_slice(F.col("snapshot_at")) if slice_ is None else slice_
    out = last_known(rows, ["id"], order, cut, F.col("signature"), "prev_signature", inclusive=False)
    return out.where(F.col("prev_signature").isNotNull() & (F.col("prev_signature") != F.col("signature")))


# --- follows -------------------------------------------------------------------------------

def follow_rows(subs: DataFrame) -> DataFrame:
    """Subscriptions (endpoint, follows JSON) as rows endpoint, kind, key, name; bad JSON follows nothing."""
    f = subs.select("endpoint", F.from_json("follows", FOLLOWS, {"mode": "PERMISSIVE"}).alias("f"))
    part = lambda kind, col: f.select(
        "endpoint", F.lit(kind).alias("kind"), F.explode(f"f.{col}").alias("key", "v")
    ).select("endpoint", "kind", "key", F.col("v.name").alias("name"))
    return part("player", "players").unionByName(part("tournament", "tournaments"))


class _Follows:
    """Which lists of matches make up what each endpoint follows, so that a hit is made once and never sorted out later.

    `matches` are stored with the surnames that stand in them; matches of the same teams share a line-up, which is searched
    once. An endpoint's first surname brings all its matches; another surname or a tournament brings a match only if nothing
    before it does, which the row itself tells. So the hits need no shuffle to be distinct. Endpoints of more than `most`
    follows are few and are made distinct. A surname that many follow and that stands in many matches, a great tournament
    and a line-up of many matches are spread over tasks (`skew.grid_join`). Shuffles and tables that are done are removed.
    `carry` is a column whose values the matches keep: a match has a row for each that its id came with.
    """

    at = ["ordinal", "id"]
    carry: str | None = None

    def __init__(self, m: DataFrame, follows: DataFrame, least: int, most: int = 200):
        carry = self.carry
        self.cols = self.at if carry is None else [*self.at, carry]
        self.no_shuffles = lambda: shuffles_removed(m.sparkSession)
        with self.no_shuffles():
            hays = F.filter(F.transform("teams", lambda t: F.lower(t["name"])), lambda h: h.isNotNull())
            told = m.select(*self.cols, tournament_key().alias("key"), hays.alias("hays"))
            one = (told if carry is None else told.repartition("id")).groupBy(*self.at).agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("hays")))).alias("lineup"), F.collect_set("key").alias("keys"),
                *[F.collect_list(c).alias(c) for c in self.cols[2:]],
            )
            if carry is not None:
                one = one.withColumn(carry, F.flatten(F.collect_list(carry).over(Window.partitionBy("id")))).withColumn(carry, F.explode(carry))
            one, path = stored(one, "told-once")
            needle = surname(F.col("name"))
            own = cut(follows.select(
                "endpoint", F.when((F.col("kind") == "player") & (F.length(needle) >= least), needle).alias("needle"),
                F.when(F.col("kind") == "tournament", F.col("key")).alias("key"),
            ).groupBy("endpoint").agg(F.array_sort(F.collect_set("needle")).alias("ps"), F.array_sort(F.collect_set("key")).alias("ts")))
            few = F.size("ps") + F.size("ts") <= most
            self.few, self.many = own.where(few), own.where(~few)
            #: what no endpoint has is not looked for
            self.n_names, self.n_tours, self.n_many = (n or 0 for n in own.agg(
                F.max(F.when(few, F.size("ps"))), F.max(F.when(few, F.size("ts"))), F.count(F.when(~few, 1))).first())
            lineups = one.select("lineup").distinct()
            shapes = spread(lineups.select("lineup", F.explode("lineup").alias("hay")))
            pairs = contains_pairs(own.select(F.explode("ps").alias("needle")), shapes.select("hay"))
            inside = grid_join(shapes, pairs, "hay", "lineup").groupBy("lineup").agg(F.collect_set("needle").alias("needles"))
            inside = lineups.join(inside, "lineup", "left").select("lineup", F.coalesce("needles", F.array().cast("array<string>")).alias("needles"))
            self.matches = stored(grid_join(spread(one), inside, "lineup", "id").select(*self.cols, "keys", "needles"), "followed")[0]
            forget(m.sparkSession, path)

    def named(self, *more: str) -> DataFrame:
        """needle and the columns of the matches for each surname that stands in them."""
        return spread(self.matches.select(F.explode("needles").alias("needle"), *self.cols, *more))

    @staticmethod
    def first(few: DataFrame, *more: str) -> DataFrame:
        """(endpoint, needle): the surname that brings all its matches."""
        return few.where(F.size("ps") > 0).select("endpoint", F.col("ps")[0].alias("needle"), *more)

    def by_name(self, few: DataFrame, since: int) -> DataFrame:
        """endpoint and the columns of the matches for hits of an endpoint's surnames from the `since`-th on, each by the first that brings it."""
        if self.n_names < 2:
            return grid_join(self.first(few), self.named(), "needle", "endpoint", "id").select("endpoint", *self.cols)
        who = few.select("endpoint", "ps", F.posexplode("ps").alias("n", "needle")).where(F.col("n") >= since).select(
            "endpoint", "needle", F.slice("ps", F.lit(1), F.col("n")).alias("before"))
        return grid_join(who, self.named("needles"), "needle", "endpoint", "id").where(~F.arrays_overlap("needles", "before")).select("endpoint", *self.cols)

    def by_tournament(self, few: DataFrame) -> DataFrame:
        """endpoint and the columns of the matches for hits that no surname of the endpoint brings."""
        tours = few.select("endpoint", "ps", "ts", F.posexplode("ts").alias("n", "key")).select(
            "endpoint", "ps", "key", F.slice("ts", F.lit(1), F.col("n")).alias("before"))
        several = ["keys"] if self.n_tours > 1 else []
        hits = grid_join(tours, spread(self.matches.select(*self.cols, "needles", *several, F.explode("keys").alias("key"))), "key", "endpoint", "id")
        hits = hits.where(~F.arrays_overlap("needles", "ps"))
        return (hits.where(~F.arrays_overlap("keys", "before")) if several else hits).select("endpoint", *self.cols)

    def of_many(self) -> DataFrame:
        """endpoint and the columns of the matches for hits of the endpoints of many follows."""
        who, its = self.many.select("endpoint", F.explode("ps").alias("needle")), self.many.select("endpoint", F.explode("ts").alias("key"))
        plain = grid_join(who, self.named().select("needle", *self.at), "needle", "endpoint", "id").select("endpoint", *self.at).unionByName(
            grid_join(its, spread(self.matches.select(*self.at, F.explode("keys").alias("key"))), "key", "endpoint", "id").select("endpoint", *self.at)).distinct()
        return plain if self.cols == self.at else plain.join(spread(self.matches.select(*self.cols)), self.at)

    def others(self, few: DataFrame, since: int = 1, many: bool = True) -> DataFrame:
        """endpoint and the columns of the matches for hits that the first `since` surnames of an endpoint do not bring."""
        parts = [self.by_name(few, since)] if self.n_names > since else []
        parts += [self.by_tournament(few)] if self.n_tours else []
        parts += [self.of_many()] if many and self.n_many else []
        none = self.few.select("endpoint").where("false").crossJoin(self.matches.select(*self.cols).where("false"))
        return reduce(DataFrame.unionByName, parts or [none])

    def hits(self) -> DataFrame:
        """endpoint and the columns of the matches for every hit, each once."""
        with self.no_shuffles():
            return self.others(self.few, 0)

    def first_hits(self, order: list[Column], k: int) -> DataFrame:
        """Each endpoint's first `k` hits in `order` (`rn`): of a first surname's matches the first `k` only."""
        with self.no_shuffles():
            of_needle = first_rows(self.named(), ["needle"], order, k).drop("rn")
            near = grid_join(self.first(self.few), of_needle, "needle", "endpoint").select("endpoint", *self.cols)
            return first_rows(near.unionByName(self.others(self.few)), ["endpoint"], order, k)

    def ranked(self, order: list[Column], most: int = 32) -> DataFrame:
        """Every hit and its place (`rn`) in the list of its endpoint.

        A first surname's matches are put in order once and not once more for each who follows it: if an endpoint has at most
        `most` other hits, each of these is told how many of the surname's matches stand before it, and moves those behind it
        on by one. Only the hits of endpoints of more other hits are sorted by endpoint.
        """
        same, needle = F.col("endpoint").eqNullSafe(F.col("e")), F.get("ps", F.lit(0)).alias("needle")
        with self.no_shuffles():
            extra = self.others(self.few, many=False).groupBy(F.col("endpoint").alias("e")).agg(F.count("*").alias("extra"))
            few = cut(self.few.join(extra, same, "left").select("endpoint", "ps", "ts", F.coalesce("extra", F.lit(0)).alias("extra")))
            n_far, n_extra = few.agg(F.count(F.when(F.col("extra") > most, 1)), F.sum(F.when(F.col("extra") <= most, F.col("extra")))).first()
            near, parts = few.where(F.col("extra") <= most), []
            who, place = self.first(near), F.col("rn")
            if n_far or self.n_many:
                parts.append(first_rows(self.others(few.where(F.col("extra") > most), 0), ["endpoint"], order, None))
            if n_extra:
                mine = self.others(near, many=False).join(near.select(F.col("endpoint").alias("e"), needle), same).select("endpoint", "needle", *self.cols)
                w = Window.partitionBy("needle").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                beside = self.named().withColumn("mine", F.lit(0)).withColumn("endpoint", F.lit(None).cast(near.schema["endpoint"].dataType)).unionByName(
                    mine.where("needle is not null").withColumn("mine", F.lit(1)))
                placed = beside.withColumn("ahead", F.sum(1 - F.col("mine")).over(w).cast("int")).where("mine = 1").drop("mine")
                mine = cut(placed.unionByName(mine.where("needle is null").withColumn("ahead", F.lit(0))))
                moved = mine.groupBy(F.col("endpoint").alias("e")).agg(F.collect_list("ahead").alias("aheads"))
                who = cut(who.join(moved, same, "left").select("endpoint", "needle", "aheads"))
                place = F.when(F.col("aheads").isNull(), place).otherwise(place + F.size(F.filter("aheads", lambda a: a < F.col("rn"))))
                parts.append(first_rows(mine.drop("needle"), ["endpoint"], order, None).withColumn("rn", F.col("rn") + F.col("ahead")).drop("ahead"))
            listed = first_rows(self.named(), ["needle"], order, None)
            parts.append(placed_join(who, listed, "needle", "endpoint", "id").select("endpoint", *self.cols, place.alias("rn")))
            return reduce(DataFrame.unionByName, parts)

    def counts(self) -> DataFrame:
        """(endpoint, n): how many hits each endpoint has; a first surname's are counted once."""
        with self.no_shuffles():
            per_name = self.named().groupBy("needle").agg(F.count("*").alias("n"))
            rest = self.others(self.few).groupBy("endpoint").agg(F.count("*").alias("n"))
            return self.first(self.few).join(per_name, "needle").select("endpoint", "n").unionByName(rest).groupBy("endpoint").agg(F.sum("n").alias("n"))


class _StatusFollows(_Follows):
    carry = "status"


def match_follows(m: DataFrame, follows: DataFrame, least: int = 3) -> DataFrame:
    """(endpoint, ordinal, id) for every match a subscriber cares about: tournament followed, or the
    surname of a followed player inside a team name. Surnames under `least` letters are not
    searched, as they stand inside many other names; 1 searches them all.
    """
    return _Follows(m, follows, least).hits()


def followed_open(m: DataFrame, follows: DataFrame, shown: int | None = None) -> DataFrame:
    """(endpoint, rn, id, status): matches of each subscriber's follows that are not over, live ones first, then in order.

    A match counts if its tournament or a player is followed (`match_follows`). `shown` keeps the first of each
    subscriber's list, as a page does, and then of a surname's matches no more are read; None keeps all.
    """
    f = _StatusFollows(m.where((F.col("status") != lk.FINAL) & F.col("id").isNotNull()), follows, 3)
    order = [status_order(F.col("status")), F.col("ordinal"), F.col("id")]
    listed = f.ranked(order) if shown is None else f.first_hits(order, shown)
    return listed.select("endpoint", "rn", "id", "status")


def teams_line(teams: Column, sep: str = " vs ") -> Column:
    return F.concat_ws(sep, F.transform(teams, lambda t: t["name"]))


def _not_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def notifications(m: DataFrame, follows: DataFrame, kind: str = "live", listed: int = 5) -> DataFrame:
    """One message per subscriber with a match: endpoint, n, title, body.

    A single match is described, several are listed by their first five team lines. The matches of a surname are counted
    by line-up and only its first five are handed to each follower; texts join those five only.
    """
    when = F.coalesce(F.concat(F.lit("~"), _not_blank(F.col("est_start"))), F.lit("soon"))
    line = teams_line(F.col("teams"))
    if kind == "live":
        one = ("🔴 Live: ", F.concat_ws(" · ", _not_blank(F.col("tournament.name")), _not_blank(F.col("round"))))
        many, text = (F.lit("🔴 "), F.lit(" of your follows are live")), line
    else:
        one = ("⏱ Starting soon: ", F.concat_ws(" · ", _not_blank(F.col("tournament.name")), _not_blank(F.col("court")), when))
        many, text = (F.lit("⏱ "), F.lit(" of your follows start soon")), F.concat(line, F.lit(" ("), when, F.lit(")"))
    lines = m.select("id", line.alias("line"), one[1].alias("detail"), text.alias("text"))
    f = _Follows(m, follows, 3)
    counts, top = f.counts(), f.first_hits([F.col("ordinal"), F.col("id")], listed)
    msg = top.join(lines, "id").groupBy("endpoint").agg(
        F.sort_array(F.collect_list(F.struct("rn", "text"))).alias("ls"),
        F.min_by("line", "rn").alias("line"), F.min_by("detail", "rn").alias("detail"),
    )
    j = msg.join(counts, "endpoint")
    single = F.col("n") == 1
    return j.select(
        "endpoint", "n",
        F.when(single, F.concat(F.lit(one[0]), F.col("line"))).otherwise(
            F.concat(many[0], F.col("n").cast("string"), many[1])).alias("title"),
        F.when(single, F.col("detail")).otherwise(F.concat_ws("\n", F.transform("ls", lambda s: s["text"]))).alias("body"),
    )


def digest(m: DataFrame, heading: str, by: list[str], listed: int = 8, footer: str = "", kind: str = "live") -> DataFrame:
    """One text per group (snapshot): the first eight matches and how many more there are.

    A live match is told with where it is played, one that starts soon with its estimate as well (or "soon").
    """
    name, court = _not_blank(F.col("tournament.name")), _not_blank(F.col("court"))
    if kind == "live":
        head, place = F.lit(": "), [name, _not_blank(F.col("round")), court]
    else:
        when = F.coalesce(F.concat(F.lit("~"), _not_blank(F.col("est_start"))), F.lit("soon"))
        head, place = F.concat(F.lit(" ("), when, F.lit("): ")), [court, _not_blank(F.col("round")), name]
    line = F.concat(region_label(F.col("federation")), head, teams_line(F.col("teams"), "  vs  "), F.lit("\n"), F.concat_ws(" · ", *place))
    rows = m.withColumn("_line", line)
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    top = first_rows(rows.select(*by, "ordinal", "id", "_line"), by, [F.col("ordinal"), F.col("id")], listed)
    text = top.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rn", "_line"))).alias("ls"))
    more = F.when(F.col("n") > listed, F.concat(F.lit("\n\n…and "), (F.col("n") - listed).cast("string"), F.lit(" more"))).otherwise("")
    body = F.concat(
        F.lit(f"{heading} ("), F.col("n").cast("string"), F.lit(")\n\n"),
        F.concat_ws("\n\n", F.transform("ls", lambda s: s["_line"])), more, F.lit(footer),
    )
    return text.join(n, by).select(*by, "n", body.alias("text"))


# --- health ---------------------------------------------------------------------------------

def last_good(status: DataFrame, order: list[str], slice_unit: str = "day") -> DataFrame:
    """Adds last_ok_at: the row's time if it succeeded, else the source's last success."""
    ok_at = F.when(F.col("ok"), F.col("snapshot_at"))
    return last_known(status, ["source"], order, time_slice(F.col("snapshot_at"), slice_unit), ok_at, "last_ok_at")


def last_good_matches(deliveries: DataFrame) -> DataFrame:
    """Matches of each source's latest successful delivery; a failed one keeps the old matches."""
    good = deliveries.where("ok").groupBy("source").agg(F.max("snapshot_at").alias("snapshot_at"))
    return deliveries.where("ok").join(good, ["source", "snapshot_at"], "left_semi")


def latest_status(status: DataFrame, order: list[str]) -> DataFrame:
    """Newest row per source with its last success."""
    at = F.struct(*order)
    return status.groupBy("source").agg(
        F.max_by(F.struct("ok", "match_count", "error"), at).alias("s"),
        F.max(F.when(F.col("ok"), F.col("snapshot_at"))).alias("last_ok_at"),
    ).select("source", "s.*", "last_ok_at")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes as a number; both arguments are zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 60e6


def health(status: DataFrame, feed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(checks: name, ok, critical; verdict: overall) as of `now`.

    status: source, ok, match_count, error, last_ok_at; feed: one row generated_at, total,
    rankings (no row when nothing was ever published). A stale or empty feed, or a failing
    source without success for three hours, is down; any other failure is a warning.
    """
    age = minutes_between(now, F.col("generated_at"))
    base = feed.select(F.explode(F.array(
        F.struct(F.lit("fresh").alias("name"), (age <= lk.FRESH_MINUTES).alias("ok"), F.lit(True).alias("critical")),
        F.struct(F.lit("volume").alias("name"), (F.coalesce("total", F.lit(0)) > 0).alias("ok"), F.lit(True).alias("critical")),
        F.struct(F.lit("rankings").alias("name"), (F.coalesce("rankings", F.lit(0)) > 0).alias("ok"), F.lit(False).alias("critical")),
    )).alias("c")).select("c.*")
    stale = minutes_between(now, F.col("last_ok_at")) / 60 > lk.SOURCE_STALE_HOURS
    sources = status.select(
        F.concat(F.lit("src:"), F.col("source").cast("string")).alias("name"), F.col("ok"),
        F.coalesce(~F.col("ok") & stale, F.lit(False)).alias("critical"),
    )
    checks = base.unionByName(sources)
    verdict = checks.agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("bad"),
        F.coalesce(F.bool_or(~F.col("ok") & F.col("critical")), F.lit(False)).alias("down"),
        F.coalesce(F.bool_or(F.col("name") == "fresh"), F.lit(False)).alias("seen"),
    ).select(
        F.when(~F.col("seen") | F.col("down"), "down").when(F.col("bad"), "warn").otherwise("ok").alias("overall")
    )
    return checks, verdict


def owns_alerts(snapshots: DataFrame, now: Column, me: str, busy_minutes: int = 10, standby_minutes: int = 35) -> DataFrame:
    """May `me` alert and produce? Another producer's fresh snapshot suppresses alerts (ten
    minutes) and production (35 minutes)."""
    last = snapshots.agg(F.max_by(F.struct("producer", "snapshot_at"), "snapshot_at").alias("s"))
    other = F.coalesce(F.col("s.producer") != me, F.lit(False))
    age = minutes_between(now, F.col("s.snapshot_at"))
    return last.select(
        (~(other & (age < busy_minutes))).alias("owns_alerts"), (other & (age < standby_minutes)).alias("standby")
    )
