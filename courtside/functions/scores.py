"""Score text and set cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from courtside.functions.text import clean, strip_cites

TIE_BREAK = r"^([67])(\d+)$"
SET_TYPE = "array<struct<a:string,b:string>>"


def games(cell: Column) -> Column:
    """Games of a set cell: a glued tie-break ("66") counts its first digit, junk counts 0."""
    leading = F.regexp_extract(cell, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.when(cell.rlike(TIE_BREAK), F.substring(cell, 1, 1).try_cast("int")).otherwise(
        F.coalesce(leading, F.lit(0))
    )


def set_parts(cell: Column) -> Column:
    """struct(games, tie_break, label) of a set cell, e.g. "75" -> 7, 5, "7(5)"."""
    text = F.coalesce(cell, F.lit(""))
    glued = text.rlike(TIE_BREAK)
    g = F.when(glued, F.regexp_extract(text, TIE_BREAK, 1)).otherwise(text)
    tb = F.when(glued, F.regexp_extract(text, TIE_BREAK, 2))
    label = F.when(glued, F.concat(g, F.lit("("), tb, F.lit(")"))).otherwise(text)
    return F.struct(g.alias("games"), tb.alias("tie_break"), label.alias("label"))


def _pairs(parts: Column, pattern: str) -> Column:
    hits = F.filter(parts, lambda t: t.rlike(pattern))
    return F.transform(
        hits,
        lambda t: F.struct(
            F.regexp_extract(t, pattern, 1).alias("a"), F.regexp_extract(t, pattern, 2).alias("b")
        ),
    )


def parse_sets(score: Column, dialect: str) -> Column:
    """Sets of a score text. Dialects: season, circuit, news, bracket."""
    if dialect == "season":      # "6–1 / 7–6", "4-6, 6-2 y 7-5"
        parts = F.split(strip_cites(score), r"(?i)\s*(?:/|,|\sy\s|\sand\s)\s*")
        return _pairs(parts, r"(\d+)\s*[–—-]\s*(\d+)")
    if dialect == "circuit":     # "6-1/7-6" or "6-1 7-6(5)"; the set starts the token
        parts = F.split(F.regexp_replace(clean(score), "/", " "), r"\s+")
        return _pairs(parts, r"^(\d+)-(\d+)")
    if dialect == "news":        # "6-4 7-6(5) ab."
        bare = F.regexp_replace(clean(score), r"(?i)\s*(?:ab\.?|wo|w/o|ret\.?)\s*$", "")
        return _pairs(F.split(bare, r"\s+"), r"(\d+)-(\d+)")
    if dialect == "bracket":     # every d-d in the text
        both = F.regexp_extract_all(F.coalesce(score, F.lit("")), F.lit(r"(\d{1,2}-\d{1,2})"), F.lit(1))
        return _pairs(both, r"^(\d+)-(\d+)$")
    raise ValueError(f"unknown score dialect: {dialect}")


# fixed values: kick-off labels and notes around bracket scores
WEEKDAY_LEAD = r"(?i)^(?:lun|mar|mie|mié|jue|vie|sab|sáb|dom)(?![A-Za-z0-9_])"
SLASH_SCORE = r"(?<![A-Za-z0-9_])\d{1,2}\s*/\s*\d{1,2}(?![A-Za-z0-9_])"
RETIRED = r"(?i)abandono|retir|lesi"
WALKOVER = r"(?i)w\.?o\.?|walkover|no se present"


def is_bracket_score(text: Column) -> Column:
    """"7/6 6/3" is a score, "mie 25/3 10.30" is a time of play."""
    t = F.coalesce(text, F.lit(""))
    return (t != "") & ~t.rlike(WEEKDAY_LEAD) & t.rlike(SLASH_SCORE) & ~t.rlike(r"^\d{1,2}[:.]\d{2}$")


def bracket_score(text: Column) -> Column:
    """"7/6 6/3" -> "7-6 6-3", with " ab." / " wo" for retirements and walkovers; else null."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2}\s*/\s*\d{1,2})"), F.lit(1))
    sets = F.transform(found, lambda s: F.regexp_replace(s, r"\s*/\s*", "-"))
    out = F.concat(
        F.concat_ws(" ", sets),
        F.when(text.rlike(RETIRED), F.lit(" ab.")).otherwise(F.lit("")),
        F.when(text.rlike(WALKOVER), F.lit(" wo")).otherwise(F.lit("")),
    )
    return F.when(F.size(sets) > 0, out)


def percent(won: Column, lost: Column) -> Column:
    """Whole percent, halves upward; null without any games."""
    total = won + lost
    return F.when(total > 0, F.floor(won * 100.0 / total + 0.5).cast("int"))


def pair_cells(a: Column, b: Column) -> Column:
    """Two rows of set cells as sets, without the sets neither side played ("-")."""
    def played(x):
        return F.coalesce((x != "") & (x != "-"), F.lit(False))

    def cell(x):
        return F.when(x == "-", F.lit("")).otherwise(F.coalesce(x, F.lit("")))

    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    kept = F.filter(zipped, lambda s: played(s["a"]) | played(s["b"]))
    return F.transform(kept, lambda s: F.struct(cell(s["a"]).alias("a"), cell(s["b"]).alias("b")))


def score_signature(sets: Column, status: Column) -> Column:
    """Text that changes exactly when the visible score or the status does."""
    shown = F.transform(sets, lambda s: F.concat_ws("-", s["a"], s["b"]))
    return F.concat(F.concat_ws(",", shown), F.lit("|"), status)
