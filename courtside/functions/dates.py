"""Date ranges, clock texts and calendar labels. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from courtside.functions import lookups as lk
from courtside.functions.text import clean


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def make_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is no such day."""
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text).try_cast("date")


# fixed value: texts of events without a date
UNDATED = r"(?i)postpone|cancel|tb[ac]|\?"


def date_range(text: Column, year: Column) -> Column:
    """struct(start, end) of "7 February – 14 February"; null when undated or unreadable.

    An end month before the start month belongs to the next year.
    """
    parts = F.filter(F.transform(F.split(text, "[–—-]"), lambda p: F.trim(p)), lambda p: p != "")

    def day_month(i):
        p = F.get(parts, F.lit(i))
        day = F.regexp_extract(p, r"(\d{1,2})\s+([A-Za-z]+)", 1).try_cast("int")
        month = lk.lookup(F.lower(F.regexp_extract(p, r"(\d{1,2})\s+([A-Za-z]+)", 2)), lk.MONTHS_EN)
        return day, month

    (d1, m1), (d2, m2) = day_month(0), day_month(1)
    single = F.size(parts) < 2
    d2, m2 = F.when(single, d1).otherwise(d2), F.when(single, m1).otherwise(m2)
    start = make_date(year, m1, d1)
    end = make_date(year + F.when(m2 < m1, 1).otherwise(0), m2, d2)
    ok = ~text.rlike(UNDATED) & start.isNotNull() & end.isNotNull()
    return F.when(ok, F.struct(start.alias("start"), end.alias("end")))


def first_dates(text: Column, locale: str = "en") -> Column:
    """Up to two dates of a card text: d.m.yyyy / d/m/yyyy tokens, else named months."""
    months = lk.MONTHS_BY_LOCALE[locale]
    edge_l, edge_r = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    num_pat = edge_l + r"(\d{1,2}[./]\d{1,2}[./]\d{4})" + edge_r
    numeric = F.transform(
        F.regexp_extract_all(text, F.lit(num_pat), F.lit(1)),
        lambda t: make_date(
            F.get(F.split(t, "[./]"), F.lit(2)), F.get(F.split(t, "[./]"), F.lit(1)), F.get(F.split(t, "[./]"), F.lit(0))
        ),
    )
    names = "|".join(sorted(months, key=len, reverse=True))
    named_pat = rf"(?i){edge_l}(\d{{1,2}}\s+(?:{names})\.?\s+\d{{4}}){edge_r}"
    bits = lambda t: F.split(F.regexp_replace(t, r"\.", ""), r"\s+")
    named = F.transform(
        F.regexp_extract_all(text, F.lit(named_pat), F.lit(1)),
        lambda t: make_date(
            F.get(bits(t), F.lit(2)), lk.lookup(F.lower(F.get(bits(t), F.lit(1))), months), F.get(bits(t), F.lit(0))
        ),
    )
    return F.slice(F.when(F.size(numeric) > 0, numeric).otherwise(named), 1, 2)


def season_start(text: Column, year: Column) -> Column:
    """First day of "19 March – 24 March" or "23 de marzo al 29 de marzo" in a season."""
    pattern = r"(\d{1,2})\s+(?:de\s+)?([A-Za-zÁÉÍÓÚáéíóú]+)"
    month = lk.lookup(F.lower(F.regexp_extract(clean(text), pattern, 2)), {**lk.MONTHS_EN, **lk.MONTHS_ES})
    return make_date(year, month, F.regexp_extract(clean(text), pattern, 1).try_cast("int"))


def dmy_date(text: Column) -> Column:
    """dd/mm/yyyy found in a text, as a date."""
    p = r"(\d{2})/(\d{2})/(\d{4})"
    part = lambda i: F.regexp_extract(text, p, i).try_cast("int")
    return make_date(part(3), part(2), part(1))


CLOCK = r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)?"
CLOCK_SECONDS = r"(?i)(\d{1,2}):(\d{2}):\d{2}\s*(AM|PM)?"


def clock_minutes(text: Column, pattern: str = CLOCK) -> Column:
    """Minutes of the day of a 12- or 24-hour clock text; null without one."""
    h = F.regexp_extract(text, pattern, 1).try_cast("int")
    half = F.upper(F.regexp_extract(text, pattern, 3))
    h24 = F.when((half == "PM") & (h < 12), h + 12).when((half == "AM") & (h == 12), F.lit(0)).otherwise(h)
    return h24 * 60 + F.regexp_extract(text, pattern, 2).try_cast("int")


def duration_minutes(text: Column) -> Column:
    p = r"(\d{1,2}):(\d{2})"
    return F.regexp_extract(text, p, 1).try_cast("int") * 60 + F.regexp_extract(text, p, 2).try_cast("int")


def format_minutes(minutes: Column) -> Column:
    """HH:MM, wrapping at midnight. Half minutes stay visible ("09:42.5")."""
    m = minutes.cast("double")
    rest = F.regexp_replace((m % 60).cast("string"), r"\.0$", "")
    rest = F.when(F.length(rest) < 2, F.lpad(rest, 2, "0")).otherwise(rest)
    return F.concat(F.lpad(F.floor((m % 1440) / 60).cast("string"), 2, "0"), F.lit(":"), rest)


def duration_label(text: Column) -> Column:
    """"01:15" -> "1h 15m", "00:38" -> "38 min", zero or junk -> null."""
    p = r"^(\d+):(\d+)"
    h = F.regexp_extract(text, p, 1).try_cast("int")
    m = F.regexp_extract(text, p, 2).try_cast("int")
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%d min", m))


def weekday3(d: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in lk.WEEKDAY3]), F.dayofweek(d) - 1)


def month3(d: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in lk.MONTH3]), F.month(d) - 1)


def day_label_date(label: Column, today: Column) -> Column:
    """Date of "JUL 16 THU": the nearest year whose weekday agrees, else this year."""
    p = r"([A-Z]{3})\s+(\d{1,2})(?:\s+([A-Z]{3}))?"
    up = F.upper(label)
    months = {m.upper(): i + 1 for i, m in enumerate(lk.MONTH3)}
    month = lk.lookup(F.regexp_extract(up, p, 1), months)
    day = F.regexp_extract(up, p, 2).try_cast("int")
    wd = F.regexp_extract(up, p, 3)
    year = F.year(today)
    options = F.transform(
        F.array(F.lit(0), F.lit(-1), F.lit(1)),
        lambda o: F.struct(
            F.abs(F.datediff(make_date(year + o, month, day), today)).alias("off"),
            make_date(year + o, month, day).alias("on"),
        ),
    )
    fits = F.filter(
        options, lambda s: s["on"].isNotNull() & ((wd == "") | (F.upper(weekday3(s["on"])) == wd))
    )
    return F.coalesce(F.array_min(fits)["on"], make_date(year, month, day))


def match_date(start_time: Column, day_label: Column, today: Column) -> Column:
    """Calendar day of a match: its start date, else its yearless day label."""
    dated = start_time.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.when(dated, F.substring(start_time, 1, 10).try_cast("date")).otherwise(
        day_label_date(day_label, today)
    )


def iso_week(d: Column) -> Column:
    """"YYYY-Www" with the ISO year of the week."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def day_diff(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def month_distance(a: Column, b: Column) -> Column:
    """Distance of two months around the year (December to January is 1)."""
    d = F.abs(a - b)
    return F.least(d, F.lit(12) - d)


def range_label(start: Column, end: Column) -> Column:
    """"3–9 Mar" or "28 Feb – 3 Mar"."""
    e = F.coalesce(end, start)
    day = lambda d: F.day(d).cast("string")
    return F.when(
        F.month(start) == F.month(e), F.concat(day(start), F.lit("–"), day(e), F.lit(" "), month3(start))
    ).otherwise(F.concat(day(start), F.lit(" "), month3(start), F.lit(" – "), day(e), F.lit(" "), month3(e)))


def card_range_label(start: Column, end: Column) -> Column:
    """Range with a year for a share card; one day prints once."""
    e = F.coalesce(end, start)
    day = lambda d: F.day(d).cast("string")
    y = F.year(e).cast("string")
    head = (
        F.when(end.isNull() | (start == end), F.concat_ws(" ", day(start), month3(start), y))
        .when(F.month(start) == F.month(e), F.concat(day(start), F.lit("–"), day(e), F.lit(" "), month3(start), F.lit(" "), y))
        .otherwise(F.concat(day(start), F.lit(" "), month3(start), F.lit(" – "), day(e), F.lit(" "), month3(e), F.lit(" "), y))
    )
    return F.when(start.isNull(), F.lit("Live · full draw · results & schedule")).otherwise(
        F.concat(head, F.lit(" · draw & results"))
    )


def when_label(start: Column, end: Column, live: Column, today: Column) -> Column:
    """On now / Finished / Today / Tomorrow / in n days."""
    e = F.coalesce(end, start)
    on = F.coalesce(live, F.lit(False)) | ((start <= today) & (e >= today))
    d = F.datediff(start, today)
    return (
        F.when(on, "On now").when(e < today, "Finished").when(d == 0, "Today").when(d == 1, "Tomorrow")
        .otherwise(F.format_string("in %d days", d))
    )


def day_heading(d: Column) -> Column:
    """"Thu 16 Jul"."""
    return F.concat_ws(" ", weekday3(d), F.day(d).cast("string"), month3(d))


def covers(start: Column, end: Column, day: Column) -> Column:
    """The day lies within [start, end]; a missing end is the start, a missing start is no."""
    return F.coalesce((start <= day) & (day <= F.coalesce(end, start)), F.lit(False))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce((start <= hi) & (F.coalesce(end, start) >= lo), F.lit(False))


