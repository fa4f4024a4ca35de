"""Runs against a search of every period at every place, and the query against the rules of its contract."""

import hashlib
import random
import zlib

from courtside.llm import periodic_runs
from courtside.llm.queries import QUERIES

from .conftest import SF


def brute(words, least=12):
    """Stretches of each period that cannot grow, at their smallest period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        same = [i + q < len(words) and words[i] == words[i + q] for i in range(len(words))]
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and same[j]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_random_word_lists():
    rng = random.Random(5)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            few = rng.choice([1, 2, 3, 6])
            w = [b"%d" % rng.randrange(few) for _ in range(rng.randrange(60))]
            if w and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, 9)
                w = [x if i < a + p else w[a + (i - a) % p] for i, x in enumerate(w)]
            docs.append(w)
        least = rng.choice([12, 12, 5, 4, 2])
        assert periodic_runs.runs_of(docs, least) == [brute(w, least) for w in docs]


def test_nested_and_neighbouring_runs():
    w = (b"a a b " * 6).split() + (b"a a b c " * 7).split() + [b"x"] * 30
    assert periodic_runs.runs_of([w, w[::-1], []]) == [brute(w), brute(w[::-1]), []]
    assert periodic_runs.collapse([b"a"] * 12 + [b"b"], [(0, 12, 1)]) == b"a b"


def test_long_runs():
    assert periodic_runs.runs_of([[b"w"] * 60_000, [b"u", b"v"] * 30_000]) == [[(0, 60_000, 1)], [(0, 60_000, 2)]]
    stops = [w for k in range(200) for w in [b"a"] * 80 + [b"%d" % k]]
    assert len(periodic_runs.runs_of([stops])[0]) == 200


def test_rows(odd, rows, both, empty):
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(both).collect())
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        if len(w) > 5000 and len(set(w)) == 1:
            found = [(0, len(w), 1)]
        else:
            found = brute(w)
        want.append((str(d), len(w), found, periodic_runs.collapse(w, found).decode()))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(odd).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic_runs.digests(periodic_runs.periodic_runs(empty)).collect() == []


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op11_periodic_runs"](spark, SF)
    assert out.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {f.dataType.simpleString() for f in out.schema.fields[:6]} == {"bigint"}
    with_runs = 0
    for r in out.collect():
        w = (texts.pop(r["doc_id"]) or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        with_runs += bool(runs)
    assert not texts and with_runs > 10
