"""Base spans against the plain expressions, check digits against published numbers, scores by the words nearby."""

import hashlib
import random
import re

from courtside.llm import pii
from courtside.llm.queries import QUERIES

from .conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, s):
    d = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])]
        return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m.group())]


def base(text):
    return [(k, s, e) for k, s, e, _, b in pii.spans(text) if b]


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    for alphabet in ("a@.-", "a@.b_ é", "0129.", "12 -", "+1 ()-.2", "a1@.+- 0😀"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert base(t) == plain(t), t


def test_long_runs_are_linear():
    for c in ("a", "1", "1.", "@", "+1(", "a@", "1 ", "@a.b"):
        text = c * (400_000 // len(c))
        assert isinstance(pii.spans(text), list)


def test_check_digits():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.mod11_10("86095742719") and not pii.mod11_10("86095742718")
    assert pii.dni("12345678Z") and pii.dni("X1234567L") and not pii.dni("12345678A")
    assert pii.nir("255081416802538") and not pii.nir("255081416802539")


def kinds(text, **more):
    return [(k, text[s:e]) for k, s, e, _, b in pii.spans(text, **more) if not b]


def test_added_kinds_and_context():
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 AND more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("DE89 3704 0044 0532 0130 01") == [] and kinds("XDE89370400440532013000") == []
    assert kinds("su DNI 12345678Z.") == [("dni", "12345678Z")]
    assert kinds("amex 3782 822463 10005") == [("short_card", "3782 822463 10005")]
    assert kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")] and kinds("part 123-45-6789") == []
    assert kinds("Steuer 86 095 742 719") == [("tax_id", "86 095 742 719")] and kinds("no 86 095 742 719") == []
    near, far, against = (pii.spans(t)[0][3] for t in ("call +1 (743) 555-3824", "x +1 (743) 555-3824", "example +1 (743) 555-3824"))
    assert near > far > against
    text = "mail a.b@c.de, call +1 (743) 555-3824!"
    assert pii.masked(text, pii.spans(text)) == "mail <EMAIL>, call <PHONE>!"
    assert pii.masked("none here", []) == "none here"


def test_rows(odd, empty):
    out = pii.find_personal_data(odd)
    assert out.columns == ["doc_id", "spans", "masked"]
    got = {(r["doc_id"], r["masked"]): [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in out.collect()}
    assert out.count() == odd.count() and all(v == plain(m) for (_, m), v in got.items() if "<" not in (m or ""))
    assert pii.digests(pii.find_personal_data(empty)).collect() == []


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op13_personal_data"](spark, SF)
    assert out.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    seen = 0
    for r in out.collect():
        want = plain(texts.pop(r["doc_id"]))
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        line = ",".join(":".join(map(str, w)) for w in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN) == line
        seen += len(want)
    assert not texts and seen
