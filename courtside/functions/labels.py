"""Rounds, categories, tiers and display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from courtside.functions import lookups as lk
from courtside.functions.dates import CLOCK, clock_minutes, format_minutes
from courtside.functions.text import word

# --- fixed values: round patterns, first match wins (semi and quarter before final) ---
ROUND_RULES = (
    (r"plats|platz|place|3rd|5th", 85),
    (r"semi", 90),
    (r"quarter|kvart", 80),
    (word(r"finals?|finale"), 100),
    (r"round of 16|1/8|" + word("r16") + "|åttendel|ottendel", 70),
    (r"round of 32|1/16|" + word("r32"), 60),
    (r"round of 64|1/32|" + word("r64"), 50),
    (r"round 1|runde 1|round one", 40),
    (r"group|gruppe|grupp|round ?robin|monrad|pool", 20),
    (r"q\d|quali|kval", 15),
)
DRAW_ROUND_RULES = (
    (r"(?i)^\s*\d+\s*[ªº°ᵃ.\-]?\s*ronda", "Qualifying"),
    (r"(?i)^\s*(?:primera|segunda|tercera|cuarta)\s+ronda", "Qualifying"),
    (r"(?i)^\s*clasificad", "Qualifying"),
    (r"(?i)^\s*(?:64|treintaidosavos|32avos)", "Round of 64"),
    (r"(?i)^\s*(?:32|dieciseisavos|16avos|16\s*º|16º)", "Round of 32"),
    (r"(?i)octavos|1\s*/\s*8|8\s*º", "Round of 16"),
    (r"(?i)cuartos|1\s*/\s*4|4\s*º", "Quarterfinal"),
    (r"(?i)semi", "Semifinal"),
    (r"(?i)^\s*final", "Final"),
)
NEWS_ROUND_RULES = (
    (r"(?i)demi|1/2", "Semifinal"),
    (r"(?i)quart|1/4", "Quarterfinal"),
    (r"(?i)huiti|1/8|8es", "Round of 16"),
    (r"(?i)seizi|1/16|16es", "Round of 32"),
    (r"(?i)qualif|qualy", "Qualifying"),
    (r"(?i)finale", "Final"),
)
CALENDAR_CATEGORY = (
    ("MAJOR", "Major"), ("FINALS?", "Finals"), (word("P1"), "P1"), (word("P2"), "P2"),
)
EVENT_CATEGORY = (
    (word("MAJOR"), "Major"), (r"FINALS?(?![A-Za-z0-9_])", "Finals"), (word("P1"), "P1"), (word("P2"), "P2"),
    ("GOLD", "Gold"), ("SILVER", "Silver"), ("BRONZE", "Bronze"), ("PROMISE", "Promises"),
)
TIER_RULES = (
    (word("major") + "|" + word("finals?"), 100), (word("p1"), 90), (word("p2"), 80),
    (word("gold"), 70), (word("silver"), 60), (word("bronze"), 50), ("promis", 30),
)
PRESTIGE_MARQUEE = r"master\s*final|premier padel finals|fip finals|season finals|final four|" + word("finals")
# fixed values: level of an event by words of its name, on the professional tour and elsewhere
PRESTIGE_RULES = (
    (PRESTIGE_MARQUEE, 100, 100), (word("major"), 92, 92), (word("p1"), 88, 88), (word("master"), 84, 84),
    (word("p2"), 80, 80), (word("gold"), 70, 70), (word("open"), 66, 42), (word("silver"), 52, 52),
    (word("challenger"), 48, 32), (word("bronze"), 34, 34), ("promis", 6, 6),
)
PRESTIGE_OTHER = 25
LEAGUE_WORDS = "(?i)" + word("liga") + "|league|extraliga|interclub|" + word("division") + \
    "|holdturnering|pool play|" + word("serie[an]?")
CATEGORY_LEAD = r"(?i)^(Men|Women|Herren|Damen|Herrer?|Damer?|Mixed)\s+"
HEADER_ROUND = r"(?i)((?<![A-Za-z0-9_])(?:Round|Runde|Final(?:e)?|Semi\w*|Quarter\w*|Kvart\w*)(?![A-Za-z0-9_]).*$)"


def round_rank(c: Column) -> Column:
    """100 final … 15 qualifying, 85 placement, 30 unknown."""
    return lk.first_match(F.lower(F.coalesce(c, F.lit(""))), ROUND_RULES, 30)


def is_knockout(c: Column) -> Column:
    knockout = [(pattern, 50 <= rank <= 100 and rank != 85) for pattern, rank in ROUND_RULES]
    return lk.first_match(F.lower(F.coalesce(c, F.lit(""))), knockout, False)


def is_final_round(c: Column) -> Column:
    """The word final(s), but no semi, quarter or 1/n."""
    hit = c.rlike("(?i)" + word("finals?")) & ~c.rlike(r"(?i)semi|quarter|1/[0-9]")
    return F.coalesce(hit, F.lit(False))


def draw_round(c: Column) -> Column:
    """English round of a Spanish bracket header, or null."""
    return lk.first_match(c, DRAW_ROUND_RULES)


def news_round(c: Column) -> Column:
    """English round of a French report, or null."""
    return lk.first_match(c, NEWS_ROUND_RULES)


def calendar_category(name: Column) -> Column:
    return lk.first_match(F.upper(F.coalesce(name, F.lit(""))), CALENDAR_CATEGORY, "P1")


def event_category(name: Column) -> Column:
    return lk.first_match(F.upper(F.coalesce(name, F.lit(""))), EVENT_CATEGORY, "FIP")


def tier(name: Column) -> Column:
    return lk.first_match(F.lower(F.coalesce(name, F.lit(""))), TIER_RULES, 0)


def prestige(name: Column, federation: Column, tour: Column) -> Column:
    """Marquee order of archive events; international ones rank above national ones."""
    n = F.lower(F.coalesce(name, F.lit("")))
    pro = F.coalesce(tour == "WPT", F.lit(False))
    on_tour = lk.first_match(n, [(pattern, level) for pattern, level, _ in PRESTIGE_RULES], PRESTIGE_OTHER)
    elsewhere = lk.first_match(n, [(pattern, level) for pattern, _, level in PRESTIGE_RULES], PRESTIGE_OTHER)
    level = F.when(pro, on_tour).otherwise(elsewhere)
    return F.when(F.coalesce(federation == "FIP", F.lit(False)), 1000).otherwise(0) + level


def split_category(class_name: Column, round_: Column) -> Column:
    """struct(cls, round): without a class, a leading Men/Women/… of the round is the class."""
    cls, rnd = F.coalesce(class_name, F.lit("")), F.coalesce(round_, F.lit(""))
    lead = F.regexp_extract(rnd, CATEGORY_LEAD, 1)
    moved = (cls == "") & (lead != "")
    return F.struct(
        F.when(moved, lead).otherwise(cls).alias("cls"),
        F.when(moved, F.trim(F.regexp_replace(rnd, CATEGORY_LEAD, ""))).otherwise(rnd).alias("round"),
    )


def split_header(header: Column) -> Column:
    """struct(class_name, round) of "Men A Round 2": the round is the tail from its word on."""
    rnd = F.nullif(F.regexp_extract(header, HEADER_ROUND, 1), F.lit(""))
    cls = F.when(rnd.isNull(), header).otherwise(F.trim(F.replace(header, rnd, F.lit(""))))
    return F.struct(F.nullif(cls, F.lit("")).alias("class_name"), rnd.alias("round"))


def gender_of(text: Column, with_dam: bool = False) -> Column:
    pattern = "(?i)female|women" + ("|dam" if with_dam else "")
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), "Women").otherwise("Men")


def competition_format(any_knockout: Column, name: Column) -> Column:
    league = F.coalesce(name, F.lit("")).rlike(LEAGUE_WORDS)
    return F.when(any_knockout, "Tournament").when(league, "League").otherwise("Tournament")


def circuit(tour: Column, federation: Column) -> Column:
    """Explicit tour, else FIP for the international federation, else none."""
    return F.coalesce(tour, F.when(federation == "FIP", "FIP"))


def country_code(c: Column) -> Column:
    """Two-letter code of a 2- or 3-letter code; junk is null."""
    code = F.upper(F.trim(c))
    return F.when(code.rlike("^[A-Z]{2}$"), code).when(
        code.rlike("^[A-Z]{3}$"), lk.lookup(code, lk.IOC_TO_ISO2)
    )


def country_of_name(c: Column) -> Column:
    """Two-letter code of a country name, "" when unknown."""
    return lk.lookup(F.lower(F.coalesce(c, F.lit(""))), lk.COUNTRY_TO_ISO2, "")


def region_label(fed: Column) -> Column:
    return F.coalesce(lk.lookup(fed, lk.REGION_LABEL), fed)


def schedule_label(start_time: Column, schedule: Column, est_start: Column) -> Column:
    """Time, "~15:00" (not before), "≈13:10" (estimate), "next", or null."""
    s = F.coalesce(schedule, F.lit(""))
    clock = format_minutes(clock_minutes(s))
    hour = F.regexp_extract(s, CLOCK, 1).try_cast("int")
    clock = F.when(hour.isNotNull(), clock)
    return (
        F.when(F.coalesce(start_time, F.lit("")) != "", F.substring(start_time, 12, 5))
        .when(clock.isNotNull(), F.when(s.rlike("(?i)not before"), F.concat(F.lit("~"), clock)).otherwise(clock))
        .when(F.coalesce(est_start, F.lit("")) != "", F.concat(F.lit("≈"), est_start))
        .when(s.rlike("(?i)follow"), F.lit("next"))
    )


def start_minute(est_start: Column, start_time: Column, schedule: Column) -> Column:
    """Minute of the day an upcoming match is ordered by: estimate, start time, then phrase."""
    text = F.coalesce(
        F.nullif(est_start, F.lit("")), F.nullif(F.substring(start_time, 12, 5), F.lit(""))
    )
    hhmm = F.split(text, ":")
    explicit = F.get(hhmm, F.lit(0)).try_cast("double") * 60 + F.get(hhmm, F.lit(1)).try_cast("double")
    return F.when(text.isNotNull(), explicit).otherwise(clock_minutes(schedule).cast("double"))


def movement_label(tracked: Column, state: Column, delta: Column) -> Column:
    """Arrow text of a ranking row; empty for a list without movement."""
    return (
        F.when(~tracked, F.lit(""))
        .when(state == "untracked", F.lit("·"))
        .when(state == "new", F.lit("NEW"))
        .when(delta > 0, F.concat(F.lit("▲"), delta.cast("string")))
        .when(delta < 0, F.concat(F.lit("▼"), (-delta).cast("string")))
        .otherwise(F.lit("–"))
    )


def era_label(from_: Column, to: Column) -> Column:
    """"2019" or "2017–19"."""
    return F.when(from_ == to, from_.cast("string")).otherwise(
        F.concat(from_.cast("string"), F.lit("–"), F.substring(to.cast("string"), 3, 10))
    )


def status_order(status: Column) -> Column:
    return F.when(status == lk.LIVE, 0).when(status == lk.UPCOMING, 1).when(status == lk.FINAL, 2).otherwise(3)


def legacy_tour(tour: Column) -> Column:
    """Historic rows from before tours were recorded belong to the WPT."""
    return F.coalesce(tour, F.lit("WPT"))
