import random

from courtside.llm import line_dedup


def shingles(line, width=5):
    w = line.lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, t=0.8):
    lines = sorted({(d, k, shingles(x)) for d, text in rows if d is not None and text for k, x in enumerate(text.split("\n"))}, key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    by_token, out = {}, set()
    for i, (d, k, s) in enumerate(lines):
        seen = {j for w in s for j in by_token.get(w, ())}
        if any(len(s & lines[j][2]) * (1 + t) >= t * (len(s) + len(lines[j][2])) - 1e-9 for j in seen):
            out.add((d, k))
        for w in s:
            by_token.setdefault(w, []).append(i)
    return out


def gone(df, **how):
    out = line_dedup.dedup_lines(df, **how)
    return out, {(r["doc_id"], k) for r in out.collect() for k in r["removed_lines"]}


def test_documents(both, rows):
    want = brute(rows)
    assert gone(both)[1] == want and len(want) > 20
    assert gone(both, chunk_bytes=100_000)[1] == want


def test_variants_of_lines(spark):
    rng, docs = random.Random(3), []
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 90))] for _ in range(30)]
    for d in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(400)}"
            lines.append(" ".join(x))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    out, got = gone(df, chunk_bytes=3000)
    assert got == want
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    for d, t in docs:
        assert text[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in want)


def test_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns + ["removed_lines"] and out.count() == odd.count()
    assert {r["doc_id"]: len(r["removed_lines"]) for r in out.collect()}[9] == 1
    same = [sorted(map(str, (tuple(r)[:1] + tuple(r)[2:8] for r in x.collect()))) for x in (odd, out)]
    assert same[0] == same[1]
    assert line_dedup.dedup_lines(empty).collect() == []


def test_rarity_counts_every_text(spark):
    """A word of the second and third text alone has a cell; before, only every fourth text was counted."""
    import numpy as np
    import xxhash

    texts = ["one", "two two", "three " * 7, "four", "five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    cells = {}
    for w in " ".join(texts).split():
        at = xxhash.xxh64_intdigest(w.encode(), 0) >> (64 - line_dedup.CELLS_BITS)
        cells[at] = cells.get(at, 0) + 1
    got = line_dedup.rarity(df)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == {k: int(np.log2(n + 1) * 4) for k, n in cells.items()}
