"""Personal data: expressions propose spans, check digits confirm them, words nearby raise or lower their score.

Every proposal is linear in the text: a run of characters is taken once, from its first, and never tried again from its middle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import narrow, slices

Span = tuple[int, int]

# The published letter table of Spanish identity numbers, and the lengths of account numbers by country.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    """Every second digit from the right doubled, digit sums added up to a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """An account number, its first four characters moved to the end and letters as two digits, leaves 1 modulo 97."""
    n = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        n = (n * (100 if v > 9 else 10) + v) % 97
    return n == 1


def mod11_10(number: str) -> bool:
    """The product chain of ISO 7064 over all digits; the last one is the check digit."""
    p = 10
    for c in number[:-1]:
        p = (p + int(c)) % 10 or 10
        p = p * 2 % 11
    return (p + int(number[-1])) % 10 == 1


def nir(number: str) -> bool:
    """The French number of 15: its last two digits are 97 less the rest modulo 97; Corsican departments count as 19 and 18."""
    own = number.replace("2A", "19").replace("2B", "18")
    return 97 - int(own[:13]) % 97 == int(own[13:])


def dni(number: str) -> bool:
    own = number.replace("-", "")
    return DNI_LETTERS[int(str("XYZ".index(own[0])) + own[1:8] if own[0] in "XYZ" else own[:8]) % 23] == own[8]


_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """From the run of local characters before each `@domain`, no further back than the address before it ends."""
    low = 0
    for m in _DOMAIN.finditer(text):
        head = text[low : m.start()]
        size = len(head) - len(head.rstrip(_LOCAL))
        low = m.start() + 1
        if size:
            yield m.start() - size, m.end()
            low = m.end()


def addresses(text: str) -> Iterator[Span]:
    """Four parts at a time of each run of numbers joined by dots; each part at most 255."""
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := q.lstrip("0")) < 4 and int(p or 0) <= 255 for q in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[Span]:
    for m in _SPACED.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(own := digits(m.group())) <= 19 and luhn(own):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PLUS.finditer(text):
        if 8 <= len(digits(m.group())) <= 15:
            yield m.span()


def matching(pattern: str, check: Callable[[str], bool]) -> Callable[[str], Iterator[Span]]:
    """Spans of `pattern`, without a match inside a longer number or word, whose characters pass `check`."""
    compiled = re.compile(rf"(?<![A-Za-z0-9])(?<![0-9][ .-])(?:{pattern})(?![A-Za-z0-9])(?![ .-][0-9])")

    def find(text):
        for m in compiled.finditer(text):
            if check(m.group().replace(" ", "")):
                yield m.span()

    return find


def short_card(number: str) -> bool:
    """13 to 15 digits of an issuer that has such numbers."""
    own = digits(number)
    issued = len(own) == 15 and own[:2] in ("34", "37") or len(own) == 14 and own[:2] in ("30", "36", "38") or len(own) == 13 and own[0] == "4"
    return issued and luhn(own)


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,31}")


def ibans(text: str) -> Iterator[Span]:
    """As many characters as the country's numbers have, single spaces left out."""
    for m in _IBAN.finditer(text):
        size, own, end = IBAN_LENGTHS.get(m.group()[:2], 0), "", m.start()
        for c in m.group():
            if len(own) == size:
                break
            own, end = own + c.strip(), end + 1
        if len(own) == size and size and not text[end : end + 1].isalnum() and mod97(own):
            yield m.start(), end


@dataclass(frozen=True)
class Kind:
    """How a kind is proposed and confirmed, the score of a confirmed span, and the words nearby that raise it."""

    name: str
    find: Callable[[str], Iterator[Span]]
    score: float
    words: str


#: The kinds whose confirmed spans always stay, then those that need a score: few of them pass their check by chance,
#: or words nearby must speak for them.
BASE = (
    Kind("email", emails, 0.9, r"e-?mail|mailto|contact|kontakt|correo|courriel|adresse"),
    Kind("ip", addresses, 0.6, r"\bip|address|host|server|login|adresse|dirección"),
    Kind("card", cards, 0.8, r"card|visa|master|credit|kredit|carte|karte|tarjeta|cvv"),
    Kind("phone", phones, 0.6, r"phone|tel|call|mobile|fax|whatsapp|handy|anruf|llam|appel"),
)
ADDED = (
    Kind("iban", ibans, 0.9, r"iban|account|konto|cuenta|compte|bank"),
    Kind("short_card", matching(r"[0-9](?:[ -]?[0-9]){12,14}", short_card), 0.5, r"card|amex|express|diners|credit|kredit|carte|karte|tarjeta|cvv"),
    Kind("nir", matching(r"[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]|[2-9][0-9]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}", nir), 0.6, r"sécu|social|nir\b|insee"),
    Kind("dni", matching(r"(?:[XYZ][0-9]{7}|[0-9]{8})-?[A-Z]", dni), 0.6, r"\bdni|\bnie\b|\bnif|identidad"),
    Kind("tax_id", matching(r"[1-9][0-9](?: ?[0-9]{3}){3}", lambda s: mod11_10(digits(s))), 0.2, r"steuer|\btax|identifikation|\bidnr|tin\b"),
    Kind("ssn", matching(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", lambda s: True), 0.3, r"ssn|social|security"),
    Kind("imei", matching(r"[0-9]{15}|[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]", lambda s: luhn(digits(s))), 0.2, r"imei|device|handset|gerät|appareil"),
)
KINDS = tuple(k.name for k in BASE + ADDED)
_WORDS = {k.name: re.compile(k.words, re.IGNORECASE) for k in BASE + ADDED}
#: Words that speak against a number being somebody's.
_AGAINST = re.compile(r"example|sample|dummy|version|isbn|order no|invoice|beispiel|exemple|ejemplo", re.IGNORECASE)


def scored(text: str, kind: Kind, start: int, end: int, before: int = 40, after: int = 20) -> float:
    """The kind's score, 0.3 more with a word for it nearby, 0.2 less with one against."""
    near = text[max(0, start - before) : start] + "\n" + text[end : end + after]
    score = kind.score + 0.3 * bool(_WORDS[kind.name].search(near)) - 0.2 * bool(_AGAINST.search(near))
    return round(min(1.0, max(0.0, score)), 2)


def spans(text: str, enough: float = 0.5) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind, then start; in code points, end exclusive.

    Confirmed spans of the base kinds all stay and may overlap each other. One of an added kind stays with a score of `enough`
    if no base span and no better one of the added kinds overlaps it.
    """
    out = [(k.name, s, e, scored(text, k, s, e), True) for k in BASE for s, e in k.find(text)]
    more = [(-score, s, e, k.name) for k in ADDED for s, e in k.find(text) if (score := scored(text, k, s, e)) >= enough]
    if more:
        taken = apart([(s, e) for _, s, e, _, _ in out])
        for score, s, e, name in sorted(more):
            k = bisect_left(taken, (s, e))
            if (not k or taken[k - 1][1] <= s) and (k == len(taken) or taken[k][0] >= e):
                taken.insert(k, (s, e))
                out.append((name, s, e, -score, False))
    return sorted(out, key=lambda r: (KINDS.index(r[0]), r[1]))


def apart(found: list[Span]) -> list[Span]:
    """The stretches that spans cover, in order."""
    out: list[Span] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def masked(text: str, found: list[tuple[str, int, int, float, bool]]) -> str:
    """`text` with each stretch that spans cover replaced by the kind of its first span, as `<EMAIL>`."""
    out, at = [], 0
    for kind, s, e, *_ in sorted(found, key=lambda r: (r[1], -r[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>, masked string"


def find_personal_data(docs: DataFrame, enough: float = 0.5, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, spans, masked) of every row: its personal data by kind and start, and its text without them.

    Whole texts are read where they lie; nothing is shuffled. A null text is empty and has no spans; repeated rows give a row
    each, an empty table none; other columns are left out, whatever their names.
    """
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]

    def run(batches):
        for b in slices(batches, slice_bytes):
            texts = [(t or b"").decode(errors="replace") for t in b.column("body").to_pylist()]
            found = [spans(t, enough) for t in texts]
            flat = [r for f in found for r in f]
            struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])
            ends = [0]
            for f in found:
                ends.append(ends[-1] + len(f))
            arrays = [pa.array(b.column("doc_id"), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), pa.array([masked(t, f) for t, f in zip(texts, found)])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "spans", "masked"])

    return narrow(docs).mapInArrow(run, SCHEMA)


def joined(spans_col) -> F.Column:
    return F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k.name}')) AS long) AS n_{k.name}") for k in BASE]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *count, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added, F.array_min(F.transform("spans", lambda s: s["score"])).alias("least_score"))
