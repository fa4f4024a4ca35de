"""Published views: URL lists and structured metadata documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions.text import archive_sub_id, url_segment, xml_escape
from courtside.operators.feed import tournament_key
from courtside.operators.ordered import first_rows

# fixed values: core pages with change frequency, priority and whether they carry a date
CORE_PAGES = (
    ("/", "hourly", "1.0", True), ("/events", "hourly", "0.8", True), ("/rankings", "daily", "0.8", True),
    ("/results", "daily", "0.7", True), ("/players", "weekly", "0.6", False),
)


def sitemap(m: DataFrame, archive: DataFrame, rankings: DataFrame, day: Column, base: str = "") -> DataFrame:
    """loc, lastmod, changefreq, priority, kind of every page, each page once per kind.

    m: source, tournament; archive: key, source, start, end; rankings: fed, category, id.
    """
    spark = m.sparkSession
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    path = lambda *parts: F.concat(F.lit(base), *parts)
    row = lambda loc, lastmod, freq, prio, kind: [
        loc.alias("loc"), lastmod.alias("lastmod"), F.lit(freq).alias("changefreq"), F.lit(prio).alias("priority"), F.lit(kind).alias("kind")
    ]
    none = F.lit(None).cast("string")
    core = spark.range(1).select(F.explode(F.array(*[
        F.struct(*row(path(F.lit(p)), iso(day) if dated else none, freq, prio, "core")) for p, freq, prio, dated in CORE_PAGES
    ])).alias("u")).select("u.*")
    lists = rankings.where("fed <> '' and category <> ''").select("fed", "category").distinct().select(
        *row(path(F.lit("/rankings/"), url_segment(F.col("fed")), F.lit("/"), url_segment(F.col("category"))), iso(day), "daily", "0.7", "ranking")
    )
    live = m.select("source", F.col("tournament.id").alias("tid")).distinct().select(
        *row(path(F.lit("/tournament/"), url_segment(F.col("source")), F.lit("/"), url_segment(F.col("tid"))), iso(day), "hourly", "0.8", "live")
    )
    old = archive.where("key <> '' and source <> ''").select(
        *row(
            path(F.lit("/tournament/"), url_segment(F.col("source")), F.lit("/"), url_segment(archive_sub_id(F.col("key"), F.col("source")))),
            iso(F.coalesce("end", "start")), "monthly", "0.5", "archive",
        )
    )
    people = rankings.where("id is not null").select(F.col("id").cast("string").alias("id")).where("id <> ''").distinct().select(
        *row(path(F.lit("/player/"), url_segment(F.col("id"))), none, "weekly", "0.5", "player")
    )
    out = core
    for part in (lists, live, old, people):
        out = out.unionByName(part)
    return out


def sitemap_xml(urls: DataFrame) -> DataFrame:
    """One <url> element per row, ready for a text writer."""
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), xml_escape(c), F.lit(f"</{name}>")), F.lit(""))
    return urls.select(F.concat(
        F.lit("  <url>"), tag("loc", F.col("loc")), tag("lastmod", F.col("lastmod")), tag("changefreq", F.col("changefreq")),
        tag("priority", F.col("priority")), F.lit("</url>"),
    ).alias("value"))


def breadcrumbs(base: str, middle: str, path: str, name: Column, item: Column) -> Column:
    crumb = lambda pos, n, i: F.struct(
        F.lit("ListItem").alias("@type"), F.lit(pos).alias("position"), n.alias("name"), i.alias("item")
    )
    return F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"),
        F.array(crumb(1, F.lit("Home"), F.lit(base + "/")), crumb(2, F.lit(middle), F.lit(base + path)), crumb(3, name, item)).alias("itemListElement"),
    )


def tournament_jsonld(t: DataFrame, base: str = "", sport: str = "Padel") -> DataFrame:
    """key, json: a SportsEvent per tournament. Organiser only with name and URL; the place
    is named by its venue, else its address; absent facts are left out."""
    url = F.concat(F.lit(f"{base}/tournament/"), url_segment(F.col("source")), F.lit("/"), url_segment(F.col("id")))
    txt = lambda c: F.nullif(F.col(c), F.lit(""))
    both = txt("organizer").isNotNull() & txt("organizer_url").isNotNull()
    fed = F.coalesce(F.concat(F.lit(" ("), txt("federation"), F.lit(")")), F.lit(""))
    event = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("SportsEvent").alias("@type"), F.col("name"),
        F.lit(sport).alias("sport"), url.alias("url"),
        F.concat("name", fed, F.lit(" — live scores, the full draw, results and schedule.")).alias("description"),
        F.lit("https://schema.org/EventScheduled").alias("eventStatus"),
        F.when(both, F.struct(F.lit("Organization").alias("@type"), txt("organizer").alias("name"), txt("organizer_url").alias("url"))).alias("organizer"),
        F.when(
            F.coalesce(txt("venue"), txt("address")).isNotNull(),
            F.struct(F.lit("Place").alias("@type"), F.coalesce(txt("venue"), txt("address")).alias("name"), txt("address").alias("address")),
        ).alias("location"),
        F.date_format("start", "yyyy-MM-dd").alias("startDate"), F.date_format("end", "yyyy-MM-dd").alias("endDate"),
    )
    return t.select("source", "id", F.to_json(event).alias("json"))


def ranking_jsonld(rows: DataFrame, base: str = "", k: int = 25) -> DataFrame:
    """fed, category, json: an ItemList per ranking with its first 25 rows."""
    by = ["fed", "category"]
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    top = first_rows(rows, by, [F.col("ordinal")], k)
    item = F.struct(
        F.lit("ListItem").alias("@type"), F.col("rank").alias("position"), F.col("name"),
        F.concat(F.lit(f"{base}/player/"), url_segment(F.col("id"))).alias("url"),
    )
    items = top.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rn", item.alias("i")))).alias("ls"))
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"),
        F.concat_ws(" ", "fed", "category", F.lit("ranking")).alias("name"), F.col("n").alias("numberOfItems"),
        F.transform("ls", lambda s: s["i"]).alias("itemListElement"),
    )
    return items.join(n, by).select(*by, F.to_json(doc).alias("json"))


def player_jsonld(players: DataFrame, base: str = "") -> DataFrame:
    """id, json: a Person per player."""
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Person").alias("@type"), F.col("name"),
        F.concat(F.lit(f"{base}/player/"), url_segment(F.col("id"))).alias("url"),
        F.upper(F.nullif(F.col("country"), F.lit(""))).alias("nationality"),
    )
    return players.select("id", F.to_json(doc).alias("json"))


def player_summary_line(p: DataFrame) -> DataFrame:
    """id, line: "ES · 12 matches · 7–5 W–L · 58% win rate" (parts without data are left out)."""
    has = F.col("total") > 0
    line = F.concat_ws(
        " · ", F.upper(F.nullif(F.col("country"), F.lit(""))),
        F.when(has, F.format_string("%d matches", F.col("total"))),
        F.when(has, F.concat(F.col("wins").cast("string"), F.lit("–"), F.col("losses").cast("string"), F.lit(" W–L"))),
        F.when(has, F.format_string("%d%% win rate", F.floor(F.col("wins") * 100.0 / F.col("total") + 0.5).cast("int"))),
    )
    return p.select("id", line.alias("line"))


def live_keys(m: DataFrame) -> DataFrame:
    return m.select(tournament_key().alias("key")).distinct()
