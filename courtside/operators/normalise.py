"""Raw source rows into the common match shape, and its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import date_range, dmy_date
from courtside.functions.labels import calendar_category, country_of_name, gender_of, split_header
from courtside.functions.scores import SET_TYPE, pair_cells, parse_sets
from courtside.functions.text import blank_to_null, clean, decode_entities, player_label, slug, strip_markup
from courtside.schema import MATCH_COLUMNS, PLAYER


def conform(df: DataFrame) -> DataFrame:
    """Exactly the columns of the match contract; what a source lacks is null."""
    have = set(df.columns)
    cols = [
        (F.col(name) if name in have else F.lit(None)).cast(type_).alias(name) for name, type_ in MATCH_COLUMNS.items()
    ]
    extra = [c for c in ("ordinal", "source_rank") if c in have]
    return df.select(*cols, *extra)


def tournament(**fields: Column) -> Column:
    names = ("id", "name", "url", "venue", "address", "organizer", "organizer_url", "ranking", "start", "end")
    types = {"start": "date", "end": "date"}
    return F.struct(
        *[fields.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names]
    )


def organiser(connected: Column, name: Column, path: Column, base: str = "") -> Column:
    """struct(name, url) when a club is connected and has both, else null."""
    n, p = blank_to_null(F.trim(name)), blank_to_null(F.trim(path))
    ok = F.coalesce(connected, F.lit(False)) & n.isNotNull() & p.isNotNull()
    return F.when(ok, F.struct(n.alias("name"), F.concat(F.lit(base), p).alias("url")))


# --- match API ---------------------------------------------------------------

def clean_date(d: Column) -> Column:
    """The source's empty date (year 0001) is null."""
    return F.when(~F.startswith(d, F.lit("0001")), blank_to_null(d))


def api_status(result: Column) -> Column:
    return (
        F.when(F.coalesce(result["IsPlayed"], F.lit(False)), lk.FINAL)
        .when(F.coalesce(F.size(result["Score"]["DetailedScoring"]), F.lit(0)) > 0, lk.LIVE)
        .otherwise(lk.UPCOMING)
    )


def api_score(result: Column) -> Column:
    s = result["Score"]
    sets = F.transform(
        s["DetailedScoring"],
        lambda g: F.struct(g["FirstParticipantScore"].alias("a"), g["SecondParticipantScore"].alias("b")),
    )
    winner = F.when(
        F.coalesce(result["IsPlayed"], F.lit(False)) & s["IsFirstParticipantWinner"].isNotNull(),
        F.when(s["IsFirstParticipantWinner"], 0).otherwise(1),
    )
    return F.struct(F.coalesce(sets, F.array().cast(SET_TYPE)).alias("sets"), winner.cast("int").alias("winner"))


def player(name: Column, country: Column) -> Column:
    return F.struct(name.alias("name"), blank_to_null(country).alias("country"))


def team_of(players: Column) -> Column:
    """Team from a list of player structs; nameless ones drop out, none at all is TBD."""
    kept = F.filter(players.cast(f"array<{PLAYER}>"), lambda p: F.coalesce(p["name"], F.lit("")) != "")
    label = F.concat_ws(" / ", F.transform(kept, lambda p: p["name"]))
    return F.struct(F.coalesce(F.nullif(label, F.lit("")), F.lit("TBD")).alias("name"), kept.alias("players"))


def api_team(side: Column) -> Column:
    return team_of(
        F.array(
            player(side["Name"], side["CountryShort"]), player(side["Player2Name"], side["Player2CountryShort"])
        )
    )


def normalise_api(raw: DataFrame, events: DataFrame, source: str, base: str = "") -> DataFrame:
    """Match-API rows joined with their events.

    events: event_id, event_name, event_url, federation, club, address, city, ranking,
    start_date, end_date (texts) and organiser (struct or null).
    """
    j = raw.join(events, "event_id")
    out = j.select(
        "ordinal",
        F.concat_ws(":", F.lit(source), F.col("Id")).alias("id"),
        F.lit(source).alias("source"), "federation",
        tournament(
            id=F.col("event_id"), name=F.col("event_name"),
            url=F.concat(F.lit(base), F.coalesce("event_url", F.lit(""))),
            venue=blank_to_null(F.col("club")),
            address=F.coalesce(blank_to_null(F.col("address")), blank_to_null(F.col("city"))),
            organizer=F.col("organiser.name"), organizer_url=F.col("organiser.url"),
            ranking=blank_to_null(F.col("ranking")),
            start=F.substring("start_date", 1, 10).try_cast("date"),
            end=F.substring("end_date", 1, 10).try_cast("date"),
        ).alias("tournament"),
        blank_to_null(F.col("TournamentClassName")).alias("class_name"),
        blank_to_null(F.col("Draw")).alias("round"), blank_to_null(F.col("Court")).alias("court"),
        api_status(F.col("MatchResult")).alias("status"),
        F.coalesce(clean_date(F.col("Date")), blank_to_null(F.col("start_date"))).alias("start_time"),
        F.array(api_team(F.col("Challenger")), api_team(F.col("Challenged"))).alias("teams"),
        api_score(F.col("MatchResult")).alias("score"),
    )
    return conform(out)


# --- order-of-play widget -----------------------------------------------------

def widget_status(summary: Column, won_a: Column, won_b: Column, cells_a: Column, cells_b: Column) -> Column:
    scored = F.exists(F.concat(cells_a, cells_b), lambda c: (c != "") & (c != "-"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(summary == "completed") | yes(won_a) | yes(won_b), lk.FINAL)
        .when(yes(summary == "live"), lk.LIVE)
        .when(yes(scored), lk.LIVE).otherwise(lk.UPCOMING)
    )


def widget_summary(text: Column) -> Column:
    """struct(status, duration) of a row's summary text."""
    dur = F.nullif(F.regexp_extract(text, r"(\d{1,2}:\d{2})", 1), F.lit(""))
    status = F.when(text.rlike("(?i)completed"), "completed").when(dur.isNotNull(), "live").otherwise("")
    return F.struct(status.alias("status"), dur.alias("duration"))


def signature(players_a: Column, players_b: Column, *rest: Column) -> Column:
    """Id text from both teams and what tells two matches of them apart; no whitespace."""
    parts = [F.concat_ws("+", players_a), F.concat_ws("+", players_b), *[F.coalesce(r, F.lit("")) for r in rest]]
    return F.regexp_replace(F.concat_ws("|", *parts), r"\s+", "")


def normalise_widget(raw: DataFrame, source: str = "fip", federation: str = "FIP") -> DataFrame:
    """Widget rows (tournament columns, day, court, schedule, names, countries, cells) as matches."""
    names = lambda s: F.filter(F.transform(f"players_{s}", lambda p: clean(p)), lambda p: p != "")
    pairs = lambda s: F.zip_with(
        names(s), F.col(f"countries_{s}"), lambda n, c: F.struct(n.alias("name"), c.alias("country"))
    )
    status = widget_status(
        F.col("summary_status"), F.col("won_a"), F.col("won_b"), F.col("cells_a"), F.col("cells_b")
    )
    winner = F.when(F.col("won_a"), 0).when(F.col("won_b"), 1)
    up = status == lk.UPCOMING
    out = raw.select(
        "ordinal",
        F.concat_ws(":", F.lit(source), F.col("event_id"), signature(names("a"), names("b"), F.col("round"))).alias("id"),
        F.lit(source).alias("source"), F.lit(federation).alias("federation"),
        tournament(id=F.col("event_id"), name=decode_entities(F.col("title")), url=F.col("link")).alias("tournament"),
        F.lit(None).alias("class_name"), blank_to_null(F.col("round")).alias("round"),
        blank_to_null(F.col("court")).alias("court"), blank_to_null(F.col("schedule")).alias("schedule"),
        F.when(up, F.col("est_start")).alias("est_start"), F.when(up, F.col("est_start_at")).alias("est_start_at"),
        F.struct(F.col("day_n").cast("int").alias("n"), F.col("day_label").alias("label")).alias("day"),
        status.alias("status"),
        F.array(team_of(pairs("a")), team_of(pairs("b"))).alias("teams"),
        F.struct(pair_cells(F.col("cells_a"), F.col("cells_b")).alias("sets"), winner.cast("int").alias("winner")).alias("score"),
    )
    return conform(out)


# --- schedule-page rows ---------------------------------------------------------

def normalise_rows(raw: DataFrame, source: str = "tournamentsoftware", prefix: str = "ts") -> DataFrame:
    """Rows of schedule pages (header, date, time, names, sets, won flags) as matches."""
    head = split_header(F.col("header"))
    sets_text = F.to_json("sets")
    decided = F.coalesce(F.col("won_a"), F.lit(False)) | F.coalesce(F.col("won_b"), F.lit(False))
    side = lambda s: team_of(
        F.transform(f"players_{s}", lambda p: F.struct(player_label(p).alias("name"), F.col("federation").alias("country")))
    )
    out = raw.select(
        "ordinal",
        F.concat_ws(":", F.lit(prefix), F.col("event_id"),
                    signature(F.col("players_a"), F.col("players_b"), F.col("header"), sets_text)).alias("id"),
        F.lit(source).alias("source"), "federation",
        tournament(id=F.col("event_id"), name=F.col("title"), url=F.col("link")).alias("tournament"),
        head["class_name"].alias("class_name"), head["round"].alias("round"),
        F.when(decided, lk.FINAL).when(F.size("sets") > 0, lk.LIVE).otherwise(lk.UPCOMING).alias("status"),
        F.when(
            F.col("date").isNotNull(),
            F.concat(F.col("date").cast("string"), F.lit("T"), F.coalesce("time", F.lit("00:00")), F.lit(":00")),
        ).alias("start_time"),
        F.array(side("a"), side("b")).alias("teams"),
        F.struct(
            F.col("sets").cast(SET_TYPE).alias("sets"),
            F.when(F.col("won_a"), 0).when(F.col("won_b"), 1).cast("int").alias("winner"),
        ).alias("score"),
    )
    return conform(out)


# --- validation -------------------------------------------------------------------

def reject_reason() -> Column:
    """Why a row is no match; null for a valid one."""
    return (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.col("source"), F.lit("")) == "", "missing source")
        .when(~F.coalesce(F.col("status").isin(*lk.STATUSES), F.lit(False)), "bad status")
        .when(F.coalesce(F.size("teams"), F.lit(-1)) != 2, "not two teams")
    )


def validate(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine with its reason)."""
    marked = m.withColumn("reason", reject_reason())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def source_verdicts(m: DataFrame) -> DataFrame:
    """Per source whether every row is valid: one bad row fails the whole delivery."""
    return m.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if(reject_reason().isNotNull()).alias("bad"),
        F.bool_and(reject_reason().isNull()).alias("ok"),
    )


# --- calendar, circuit finals, year-end pairs ---------------------------------------

def calendar_rows(rows: DataFrame, year: Column) -> DataFrame:
    """Calendar events of table rows (cells: name, city, country, dates)."""
    cell = lambda i: F.get("cells", F.lit(i))
    span = date_range(cell(3), year)
    out = rows.where(F.size("cells") >= 4).select(
        "page_id", "r", cell(0).alias("name"), cell(1).alias("city"),
        country_of_name(cell(2)).alias("country"), span.alias("span"),
    )
    ok = (F.col("name") != "") & ~F.col("name").rlike("(?i)^tournament$") & F.col("span").isNotNull()
    return out.where(ok).select(
        "page_id", "r", F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        "name", "city", "country", F.lit("Premier Padel").alias("tour"), calendar_category(F.col("name")).alias("category"),
    )


def pair_names(a: Column, b: Column) -> Column:
    return F.filter(F.array(clean(a["name"]), clean(b["name"])), lambda n: n != "")


def pair_ids(a: Column, b: Column) -> Column:
    """Player ids of a pair without placeholders ("nd…")."""
    return F.filter(
        F.array(a["player_id"], b["player_id"]),
        lambda i: i.isNotNull() & (i != "") & ~i.rlike("(?i)^nd"),
    )


def circuit_rows(raw: DataFrame) -> DataFrame:
    """Typed final rows: names, ids, sets, dates."""
    return raw.select(
        "ordinal", "circuit", F.col("year").try_cast("int").alias("year"), clean(F.col("tournament")).alias("name"),
        blank_to_null(clean(F.col("city"))).alias("city"), blank_to_null(clean(F.col("country.name"))).alias("country"),
        dmy_date(F.col("final_date")).alias("final_date"), "gender",
        pair_names(F.col("winner_player"), F.col("winner_partner")).alias("winners"),
        pair_names(F.col("finalist"), F.col("finalist_partner")).alias("runners_up"),
        pair_ids(F.col("winner_player"), F.col("winner_partner")).alias("winner_ids"),
        pair_ids(F.col("finalist"), F.col("finalist_partner")).alias("runner_ids"),
        blank_to_null(clean(F.col("score"))).alias("score"), parse_sets(F.col("score"), "circuit").alias("sets"),
    )


def circuit_finals(raw: DataFrame, tour: str) -> tuple[DataFrame, DataFrame]:
    """(hist_tournament, hist_final) of a circuit; per final the later row wins.

    A tournament takes its facts from its first row and needs at least one final.
    """
    rows = circuit_rows(raw).where("name <> ''").withColumn(
        "key", F.concat_ws("-", slug(F.lit(tour)), F.col("year").cast("string"), slug(F.col("name")))
    )
    facts = rows.groupBy("key").agg(
        F.min_by(
            F.struct(
                "name", "year", "city", "country",
                F.coalesce("final_date", F.make_date("year", F.lit(1), F.lit(1))).alias("start"),
            ),
            "ordinal",
        ).alias("t")
    )
    won = rows.where(F.size("winners") > 0).withColumn("gender", gender_of(F.col("gender")))
    finals = won.groupBy("key", "gender").agg(
        F.max_by(F.struct("winners", "runners_up", "score", "sets", "winner_ids", "runner_ids"), "ordinal").alias("f")
    ).select("key", "gender", "f.*")
    tournaments = facts.join(finals.select("key").distinct(), "key", "left_semi").select(
        "key", "t.*"
    ).withColumn("tour", F.lit(tour))
    return tournaments, finals


def no1_rows(rows: DataFrame) -> DataFrame:
    """Year-end number-one pairs: year, authority, gender, players (name, country, code)."""
    raw = lambda i: F.get("raw", F.lit(i))
    def one(i):
        code = F.nullif(F.upper(F.regexp_extract(raw(i + 1), r"(?i)alt=['\"]([A-Za-z]{2,3})\s*flag['\"]", 1)), F.lit(""))
        place = F.nullif(F.regexp_extract(raw(i + 1), r"(?i)uploads/[^'\"]*?/([A-Za-z_]+?)_Fip", 1), F.lit(""))
        return F.struct(
            strip_markup(raw(i)).alias("name"), F.regexp_replace(place, "_", " ").alias("country"), code.alias("code")
        )
    pair = lambda i: F.filter(F.array(one(i), one(i + 2)), lambda p: p["name"] != "")
    typed = rows.where(F.size("raw") >= 9).select(
        "page_id", strip_markup(raw(0)).try_cast("int").alias("year"),
        F.coalesce(strip_markup(raw(9)), F.lit("")).alias("authority"), pair(1).alias("men"), pair(5).alias("women"),
    ).where("year >= 1900")
    both = typed.select(
        "page_id", "year", "authority",
        F.explode(F.array(
            F.struct(F.lit("Men").alias("gender"), F.col("men").alias("players")),
            F.struct(F.lit("Women").alias("gender"), F.col("women").alias("players")),
        )).alias("g"),
    )
    return both.select("page_id", "year", "authority", "g.*").where(F.size("players") > 0)


def historic_matches(finals: DataFrame, rounds: DataFrame) -> DataFrame:
    """Archive-shaped rows of historic seasons: Men first, final first, then its rounds.

    The winners are side A. Order is a column, not a row position.
    """
    side = lambda names: team_of(
        F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("country")))
    )
    f = finals.select(
        "key", "gender", F.lit("Final").alias("round"), F.col("winners").alias("w"), F.col("runners_up").alias("l"),
        "sets", F.lit(-1).cast("long").alias("pos"),
    )
    r = rounds.select(
        "key", "gender", "round", F.col("winners").alias("w"), F.col("losers").alias("l"), "sets",
        F.col("ordinal").cast("long").alias("pos"),
    )
    rows = f.unionByName(r).where(F.col("gender").isin("Men", "Women"))
    return rows.select(
        "key", F.col("gender").alias("class_name"), "round",
        F.struct(F.when(F.col("gender") == "Men", 0).otherwise(1).alias("g"), F.col("pos")).alias("place"),
        F.array(side(F.col("w")), side(F.col("l"))).alias("teams"),
        F.struct(F.coalesce("sets", F.array().cast(SET_TYPE)).alias("sets"), F.lit(0).alias("winner")).alias("score"),
    )
