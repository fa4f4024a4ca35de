"""Lines as sets of words, as op2 and the pipeline compare them, against all earlier lines."""

import random

import corpus_pipeline
from courtside.llm import line_dedup
from courtside.llm.queries import LINES, QUERIES

from .conftest import SF


def words(line, whole=5):
    w = line.lower().split()
    return frozenset([tuple(w)] if len(w) < whole else w)


def brute(rows, t=0.8):
    lines = sorted({(d, k, words(x)) for d, text in rows if d is not None and text for k, x in enumerate(text.split("\n")) if x.split()}, key=lambda x: x[:2])
    by_token, out = {}, set()
    for i, (d, k, s) in enumerate(lines):
        if any(len(s & lines[j][2]) * (1 + t) >= t * (len(s) + len(lines[j][2])) - 1e-9 for j in {j for w in s for j in by_token.get(w, ())}):
            out.add((d, k))
        for w in s:
            by_token.setdefault(w, []).append(i)
    return out


def gone(df, **how):
    return {(r["doc_id"], k) for r in line_dedup.dedup_lines(df, **LINES, **how).collect() for k in r["removed_lines"]}


def test_documents(both, rows):
    want = brute(rows)
    assert gone(both) == want and len(want) > 20
    assert gone(both, chunk_bytes=100_000) == want


def test_variants_of_lines(spark):
    rng, docs = random.Random(4), []
    base = [[f"w{rng.randrange(600)}" for _ in range(rng.choice([6, 12, 25, 60, 150, 400]))] for _ in range(30)]
    for d in range(200):
        lines = []
        for _ in range(rng.randint(1, 4)):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, max(2, len(x) // 6))):
                x[rng.randrange(len(x))] = f"w{rng.randrange(600)}"
            lines.append(" ".join(x))
        docs.append((d, "\n".join(lines)))
    want = brute(docs)
    assert gone(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=3000) == want


def test_long_lists_of_variants(spark):
    """Lists of more lines than are met in turn, and of fewer, under the same words; no settings of the session stay changed."""
    rng, docs = random.Random(6), []
    base = [[f"w{b}_{k}" for k in range(40)] for b in range(4)]
    for d in range(220):
        x = list(base[0] if d % 3 else rng.choice(base[1:]))
        for _ in range(rng.randint(1, 7)):
            x[rng.randrange(len(x))] = f"v{rng.randrange(300)}"
        docs.append((d, " ".join(x)))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, want = spark.conf.get(key), brute(docs)
    assert gone(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=3000) == want
    assert line_dedup._SHORT_RUN < len(want) < len(docs) and spark.conf.get(key) == before


def test_one_changed_word(spark):
    x = "the shop in the old town opens at nine on monday and closes late"
    df = spark.createDataFrame([(1, x), (2, x.replace("monday", "friday"))], "doc_id long, text string")
    assert gone(df) == {(2, 0)}


def test_short_lines(spark):
    df = spark.createDataFrame([(1, "Home\nRead more\n\n \na a a a a\nsigned by the editor"), (2, "read  MORE\nmore read\n\n \na\nhome page\nhome")], "doc_id long, text string")
    assert gone(df) == {(2, 0), (2, 6)}


def test_query_and_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["lines_removed"] for r in QUERIES["op2_line_dedup"](spark, SF).collect()) == len(want)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplicated(spark, docs, SF).collect()}
    for r in docs.collect():
        own = "\n".join(x for k, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], k) not in want)
        assert kept.get(r["doc_id"], "") == own or not own.strip()


def test_words_are_hashed_together(monkeypatch):
    """Each word keeps its own hash, but only long words and short lines are hashed one by one; before, each word was."""
    import xxhash

    from courtside.llm import common

    rng = random.Random(5)
    word = lambda most: bytes(rng.choice(b"abc\x00\xc3\xa9") for _ in range(rng.randint(1, most)))
    lines = [b" \t".join(word(31) for _ in range(rng.randint(5, 60))) for _ in range(300)]
    lines += [b"", b" \r", b"read  more ", b"x" * 32 + b" a b c d", b" ".join(word(90) for _ in range(9))]
    split = [x.split() for x in lines]
    for width, whole in ((1, 5), (5, 5), (2, 0)):
        want = [[b" ".join(w) + b" ", *[b""] * (width - 1)] if 0 < len(w) < whole else w for w in split]
        hashes = [xxhash.xxh64_intdigest(x, 0) for w in want for x in w]
        calls, one = [], xxhash.xxh64_intdigest
        with monkeypatch.context() as m:
            m.setattr(common.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or one(*a))
            counts, h = line_dedup.hashed_words(lines, width, whole)
        assert counts.tolist() == [len(w) for w in want] and h.tolist() == hashes
        assert len(calls) < 20 < len(hashes) / 100
