"""Selections over events, feeds, archives and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import covers, match_date, overlaps
from courtside.functions.labels import circuit
from courtside.operators.ordered import first_rows


def covers_day(events: DataFrame, day: Column) -> DataFrame:
    return events.where(covers(F.col("start"), F.col("end"), day))


def overlaps_window(events: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return events.where(overlaps(F.col("start"), F.col("end"), lo, hi))


def calendar_events(
    events: DataFrame, day: Column, back: int = 3, forward: int = 3, first: int | None = None,
    central: tuple[str, ...] = lk.CENTRAL_FEDERATIONS,
) -> DataFrame:
    """Events around a day outside the centrally hosted countries, in feed order.

    `first` cuts the list to a report's length.
    """
    hit = events.where(overlaps(F.col("start"), F.col("end"), F.date_add(day, -back), F.date_add(day, forward)))
    hit = hit.where(
        F.col("event_id").isNotNull() & F.col("country").isNotNull() & ~F.upper("country").isin(*central)
    ).withColumn("country", F.upper("country"))
    return hit.orderBy("ordinal").limit(first) if first else hit


def recently_modified(events: DataFrame, day: Column, days: int = 2) -> DataFrame:
    """Events modified since two days before `day`, youth slugs excluded; year from the slug."""
    year = F.regexp_extract("slug", r"-(\d{4})(?![A-Za-z0-9_])", 1)
    return events.where(
        (F.col("modified") >= F.date_add(day, -days)) & ~F.col("slug").rlike("(?i)promis|promos")
    ).withColumn("year", F.coalesce(F.nullif(year, F.lit("")), F.year(day).cast("string")))


def search_text(m_name: Column, teams: Column, class_name: Column) -> Column:
    return F.lower(F.concat_ws(
        " ", F.coalesce(m_name, F.lit("")), F.concat_ws(" ", F.transform(teams, lambda t: t["name"])),
        F.coalesce(class_name, F.lit("")),
    ))


def feed_filter(status: str = "all", fed: str = "all", q: str = "") -> Column:
    """Status, federation and text conditions of the live feed."""
    q = q.strip().lower()
    cond = F.lit(True)
    if status != "all":
        cond = cond & (F.col("status") == status)
    if fed != "all":
        cond = cond & (F.col("federation") == fed)
    if q:
        hay = search_text(F.col("tournament.name"), F.col("teams"), F.col("class_name"))
        cond = cond & F.contains(hay, F.lit(q))
    return cond


def filter_feed(m: DataFrame, today: Column, status="all", fed="all", day: str = "all", q: str = "") -> DataFrame:
    out = m.where(feed_filter(status, fed, q))
    if day != "all":
        out = out.where(match_date(F.col("start_time"), F.col("day.label"), today) == F.lit(day).cast("date"))
    return out


def archive_axes(fed="all", tour="all", year="all", month="all", q: str = "") -> dict[str, Column]:
    """One condition per filter axis, so that counts can leave one axis out."""
    yes = lambda want, cond: F.lit(True) if want == "all" else F.coalesce(cond, F.lit(False))
    return {
        "fed": yes(fed, F.col("federation") == fed),
        "tour": yes(tour, circuit(F.col("tour"), F.col("federation")) == tour),
        "year": yes(year, F.date_format("start", "yyyy") == year),
        "month": yes(month, F.date_format("start", "MM") == month),
        "q": yes("all" if not q.strip() else q, F.contains(F.lower("name"), F.lit(q.strip().lower()))),
    }


def all_axes(axes: dict[str, Column], skip: str = "") -> Column:
    cond = F.lit(True)
    for name, c in axes.items():
        if name != skip:
            cond = cond & c
    return cond


def filter_archive(index: DataFrame, skip: str = "", **axes) -> DataFrame:
    return index.where(all_axes(archive_axes(**axes), skip))


def recent_or_future(events: DataFrame, today: Column, days: int = 3) -> DataFrame:
    return events.where(F.coalesce("end", "start") >= F.date_add(today, -days))


def ranking_filter(rows: DataFrame, q: str = "", country: str | None = None) -> DataFrame:
    q = q.strip().lower()
    if q:
        has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
        rows = rows.where(has("name") | has("club"))
    return rows.where(F.col("country") == country) if country else rows


def play_days(days: DataFrame, day: Column, back: int = 4, forward: int = 7, first: int | None = None) -> DataFrame:
    """Distinct play days of eight-digit codes around `day`, in order per event; `first` keeps that many."""
    ok = days.where(F.col("code").rlike(r"^\d{8}$")).select(
        "event_id", F.try_to_date("code", "yyyyMMdd").alias("play_day")
    )
    near = ok.where(F.col("play_day").between(F.date_add(day, -back), F.date_add(day, forward))).distinct()
    return first_rows(near, ["event_id"], [F.col("play_day")], first)


def valid_rounds(rounds: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable extracted matches, drop counts per reason). `known` holds the tournament keys.

    Expects winners, losers and sets.
    """
    k = known.select("key").distinct().withColumn("_known", F.lit(True))
    pair = lambda c: F.coalesce(F.size(c), F.lit(0)) == 2
    reason = (
        F.when(F.col("_known").isNull(), "unknown key")
        .when(~pair("winners") | ~pair("losers"), "bad pair")
        .when(F.coalesce(F.size("sets"), F.lit(0)) < 1, "no score")
    )
    marked = rounds.join(k, "key", "left").withColumn("reason", reason).drop("_known")
    dropped = marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return marked.where("reason is null").drop("reason"), dropped


def self_loss(winners: Column, losers: Column) -> Column:
    """A loser spelled like a winner: the row contradicts itself."""
    from courtside.functions.text import slug

    keys = lambda names: F.transform(names, lambda n: slug(n, ""))
    return F.arrays_overlap(keys(winners), keys(losers))
