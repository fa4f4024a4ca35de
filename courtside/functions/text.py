"""Text helpers as plain Column expressions (everything stays in the JVM)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from courtside.functions.lookups import bind

BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def word(pattern: str) -> str:
    """`pattern` as a whole word in the ASCII sense, whatever the JVM's \\b means."""
    return f"{EDGE_L}(?:{pattern}){EDGE_R}"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Collapse runs of whitespace and trim; null becomes the empty string."""

    def tidy(s):
        # only single spaces between characters of one byte: no pattern is needed to find them
        plain = F.octet_length(s) == F.char_length(s)
        for blank in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
            plain = plain & ~F.contains(s, F.lit(blank))
        return F.when(plain, F.trim(s)).otherwise(F.trim(F.regexp_replace(s, BLANK, " ")))

    return bind(F.coalesce(c, F.lit("")), tidy)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every letter whose canonical decomposition is one base letter plus marks.

    The table is derived from Unicode, not listed; letters such as o-slash or
    sharp s have no decomposition and stay as they are.
    """
    src, dst = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


def unaccent(c: Column) -> Column:
    src, dst = _accent_table()
    # a text of one byte a character has no accents
    return bind(c, lambda s: F.when(F.octet_length(s) == F.char_length(s), s).otherwise(
        F.translate(F.regexp_replace(s, r"[\u0300-\u036f]", ""), src, dst)
    ))


def fold(c: Column) -> Column:
    """Lower case without accents; null becomes the empty string."""
    return unaccent(F.lower(F.coalesce(c, F.lit(""))))


def slug(c: Column, sep: str = "-") -> Column:
    """Folded letters and digits joined by `sep` (use "" for a compact key)."""
    joined = F.regexp_replace(fold(clean(c)), "[^a-z0-9]+", sep)
    return F.trim(joined, F.lit(sep)) if sep else joined


def name_key(names: Column, compact: bool = True) -> Column:
    """Order-free key of a list of names, e.g. both players of a pair."""
    one = (lambda n: slug(n, "")) if compact else (lambda n: fold(F.trim(n)))
    return F.concat_ws("+", F.array_sort(F.transform(names, one)))


def tokens(c: Column, min_len: int, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of at least `min_len` characters outside `stop`."""
    words = F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: F.length(w) >= min_len)
    words = F.array_distinct(words)
    return F.array_except(words, F.array(*[F.lit(s) for s in stop])) if stop else words


def overlap(a: Column, b: Column) -> Column:
    """Shared share of two token sets, relative to the smaller one."""
    smaller = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(smaller > 0, shared / smaller).otherwise(F.lit(0.0))


def strip_cites(c: Column) -> Column:
    """Drop footnote markers such as [12], [a] or [nb 1]."""
    return F.trim(F.regexp_replace(clean(c), r"(?i)\[(?:\d+|[a-z]|nb ?\d+)\]", ""))


def strip_markup(html: Column) -> Column:
    """Visible text of an HTML fragment: tags, entities and [n] markers removed."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    out = F.regexp_replace(out, "(?i)&[a-z#0-9]+;", " ")
    return clean(F.regexp_replace(out, r"\[\s*\d+\s*\]", ""))


# fixed values: character references of article bodies and what is read for them
ARTICLE_REFERENCES = (("&#(?:8217|8216);", "'"), ("&#(?:8211|8212);", "-"), ("(?i)&[a-z#0-9]+;", " "))


def article_text(html: Column) -> Column:
    """Text of an article body: tags end lines, quotes and dashes are kept readable."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", "\n")
    for pattern, char in ARTICLE_REFERENCES:
        out = F.regexp_replace(out, pattern, char)
    out = F.regexp_replace(out, "[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n\s*\n+", "\n"), F.lit(" \n\t\r"))


def decode_entities(c: Column) -> Column:
    """The handful of entities event titles carry, as characters."""
    for pattern, char in (
        ("&#8211;", "–"), ("&#038;|&amp;", "&"), ("&#8217;", "’"),
        ("&hellip;", "…"), ("&nbsp;", " "),
    ):
        c = F.regexp_replace(c, pattern, char)
    return F.trim(c)


def unglue_year(c: Column) -> Column:
    """"Liga2026" -> "Liga 2026" at the end of a title."""
    return F.regexp_replace(c, r"([^\d\s])(\d{4})$", "$1 $2")


def undouble(c: Column) -> Column:
    """"Spain Spain" -> "Spain" (flag text followed by the same name); "" -> null."""
    v = clean(c)
    return blank_to_null(F.regexp_replace(v, r"^(.+) \1$", "$1"))


def player_label(c: Column) -> Column:
    """A display name without a trailing [seed, entry] tag and captain marker."""
    out = F.regexp_replace(c, r"\s*\[[^\]]*\]\s*$", "")
    return F.trim(F.regexp_replace(out, r"\s*\(C\)\s*$", ""))


def pair_label(c: Column) -> Column:
    """A pair cell without its trailing parenthesised note."""
    return clean(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def split_pair(c: Column) -> Column:
    """"A y B" / "A and B" / "A & B" as up to two names; otherwise the text itself."""
    txt = strip_cites(c)
    parts = F.filter(
        F.transform(F.split(txt, r"(?i)\s+(?:y|and|&)\s+"), lambda p: F.trim(p)), lambda p: p != ""
    )
    return (
        F.when(txt == "", F.array().cast("array<string>"))
        .when(F.size(parts) >= 2, F.slice(parts, 1, 2))
        .otherwise(F.array(txt))
    )


# fixed values: cell texts that hold no player
PLACEHOLDER = r"(?i)^(?:exento|exenta|bye|previa|preprevia|clasificad|qualifier|-+)"


def pair_from_lines(lines: Column) -> Column:
    """The players of a bracket cell given as lines (nationalities, seeds and byes removed)."""
    kept = F.filter(
        lines,
        lambda l: ~l.rlike(r"^\(") & ~l.rlike(r"^\d+$") & ~l.rlike(PLACEHOLDER),
    )
    bare = F.transform(
        kept,
        lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, r"^\s*\d+[.\-)]?\s*", ""), r"\s*\([^)]*\)", "")),
    )
    bare = F.filter(bare, lambda l: l != "")

    def halved(names):
        halves = F.filter(F.transform(F.split(F.get(names, F.lit(0)), "/"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when((F.size(names) == 1) & (F.size(halves) == 2), halves).otherwise(names)

    return bind(bare, halved)


def surname(c: Column) -> Column:
    """Last word of a name, lower case."""
    return F.lower(F.element_at(F.split(F.trim(F.coalesce(c, F.lit(""))), BLANK), -1))


def follow_key(id_: Column, name: Column) -> Column:
    """Stable follow key: the id, else the name marked as such, else empty."""
    return F.coalesce(
        blank_to_null(id_.cast("string")), F.concat(F.lit("n:"), blank_to_null(name)), F.lit("")
    )


def archive_sub_id(key: Column, source: Column) -> Column:
    """Id part of a "source-id" key."""
    prefix = F.concat(source, F.lit("-"))
    return F.when(F.startswith(key, prefix), F.substr(key, F.length(prefix) + 1)).otherwise(key)


def url_segment(c: Column) -> Column:
    """Percent-encoded path segment (a space is %20, and !'()* stay literal)."""
    out = F.url_encode(c.cast("string"))
    for enc, raw in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(enc), F.lit(raw))
    return out


def xml_escape(c: Column) -> Column:
    for raw, enc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(enc))
    return c


# fixed values: texts that mark a cancelled or unplayed event, and a report on a round
NOT_PLAYED = r"(?i)cancel|suspend|aplazad|not held|no\s+(?:se\s+)?disput"
ROUND_REPORT = r"(?i)demi|1/2|1/4|1/8|quart|huitiem|finale?|master|open|challenger|tour|resultat"
SCORE_LIKE = r"\d[/-]\d"


def not_played(name: Column, winner: Column) -> Column:
    return name.rlike(NOT_PLAYED) | F.coalesce(winner, F.lit("")).rlike(NOT_PLAYED)


def is_round_report(title: Column, text: Column, city: Column) -> Column:
    """An article about a round: names the city, a round word and a score."""
    both = F.concat_ws(" ", title, text)
    return F.contains(fold(both), fold(city)) & both.rlike(ROUND_REPORT) & text.rlike(SCORE_LIKE)


def player_score(a: Column, b: Column) -> Column:
    """Evidence that two spellings name one player: 2 per shared long word, 1 for a prefix."""
    return bind(F.struct(_long_words(a).alias("a"), _long_words(b).alias("b")), lambda s: _evidence(s["a"], s["b"]))


def _long_words(name: Column) -> Column:
    """Folded words of four letters or more, repeats included."""
    return F.filter(F.split(fold(name), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)


def _evidence(left: Column, right: Column) -> Column:
    # a repeated word counts each time it occurs on the left
    shared = F.size(F.filter(left, lambda w: F.array_contains(right, w)))
    prefix = F.exists(
        left,
        lambda x: F.exists(right, lambda y: (x != y) & (F.startswith(x, y) | F.startswith(y, x))),
    )
    return shared * 2 + F.when(prefix, 1).otherwise(0)


def same_pair(p: Column, q: Column) -> Column:
    """Two name lists are one pair if every player matches, in either order.

    The words of each name are taken once: inside a lambda an expression is evaluated for every element.
    """
    words = [_long_words(F.get(names, F.lit(i))).alias(f"{side}{i}") for side, names in (("p", p), ("q", q)) for i in (0, 1)]

    def match(w):
        alike = lambda i, j: _evidence(w[f"p{i}"], w[f"q{j}"]) >= 2
        return (alike(0, 0) & alike(1, 1)) | (alike(0, 1) & alike(1, 0))

    sized = (F.coalesce(F.size(p), F.lit(0)) > 0) & (F.size(p) == F.size(q)) & (F.size(p) > 1)
    return F.coalesce(sized & bind(F.struct(*words), match), F.lit(False))


def fused_pair(stored: Column, players: Column) -> Column:
    """A list that is not a pair but whose text holds a long word of each given player."""
    hay = tokens(F.concat_ws(" ", stored), 4)
    held = F.forall(players, lambda p: F.exists(tokens(p, 4), lambda t: F.array_contains(hay, t)))
    return F.coalesce((F.size(stored) > 0) & (F.size(stored) != 2) & held, F.lit(False))
