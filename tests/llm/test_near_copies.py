"""The near-dedup stage against the Jaccard likeness of all pairs, and the whole pipeline by its present rules."""

import random

import corpus_pipeline as cp
from courtside.llm import near_dedup
from courtside.llm.common import shared, table

from .conftest import SF
from .test_decontamination import brute as brute_hits
from .test_line_words import brute as brute_lines
from .test_near_dedup import brute_components, brute_fingerprint


def shingles(text, width=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def like(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9 if a and b else False


def brute(rows):
    """Positions of the rows that stay: no smaller id is like them or in their SimHash group."""
    sets = [shingles(t) for _, t in rows]
    comp = brute_components([(d, brute_fingerprint(t, 5)) for d, t in rows])
    return [i for i, (d, _) in enumerate(rows) if d is None or d == comp[i] and not any(e is not None and e < d and like(sets[i], sets[j]) for j, (e, _) in enumerate(rows))]


def edited(text, rng, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
    return " ".join(w)


def test_edited_copies(spark, rows):
    rng = random.Random(7)
    base = [(d, t) for d, t in rows if d is not None and d > 1000]
    docs = base + [(5000 + k, edited(t, rng, rng.randint(1, max(1, len(t.split()) // 40)))) for k, (_, t) in enumerate(base) if t and t.split()]
    df = shared(spark.createDataFrame(docs, "doc_id long, text string"), "test-copies")
    want = {docs[i][0] for i in brute(docs)}
    assert {r["doc_id"] for r in near_dedup.without_copies(df).collect()} == want
    assert len(want) < near_dedup.keep_first(df, width=5).count() - 20


def test_odd_rows(both):
    stored = shared(both, "test-odd")
    out = near_dedup.without_copies(stored)
    assert out.columns == both.columns
    docs = [(r["doc_id"], r["text"]) for r in stored.collect()]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(str(docs[i]) for i in brute(docs))


def test_stages(spark):
    kept = [table(spark, SF, "documents")]
    for _, stage in cp.STAGES[:-1]:
        kept.append(shared(stage(spark, kept[-1], SF), "test-stage"))
    rows = [[(r["doc_id"], r["text"]) for r in k.orderBy("doc_id").collect()] for k in kept]
    gone = brute_lines(rows[1])
    lines = [(d, "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)) for d, t in rows[1]]
    assert rows[2] == [(d, t) for d, t in lines if t.strip(" ") or not any(g[0] == d for g in gone)]
    assert rows[3] == [rows[2][i] for i in brute(rows[2])]
    hit = {r[0] for r in brute_hits(rows[3], [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]) if r[2]}
    assert rows[4] == [r for r in rows[3] if r[0] not in hit]
    assert {r["doc_id"] for r in cp.run(spark, SF).collect()} == {d for d, _ in rows[4]}
