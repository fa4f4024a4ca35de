import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from courtside.llm import substring_dedup


def brute(rows, width=20):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    big = 1 << 63
    for d, w in docs:
        for i in range(len(w) - width + 1):
            k, at = tuple(w[i : i + width]), (big if d is None else d, i)
            first[k] = min(first.get(k, at), at)
    out = Counter()
    for d, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (big if d is None else d, i):
                gone.update(range(i, i + width))
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    return out


def result(df, **how):
    out = substring_dedup.remove_repeated(df, **how)
    n = F.aggregate("removed", F.lit(0), lambda n, s: n + s["length"])
    return Counter(tuple(r) for r in out.select("doc_id", "n_words", n, F.sha2(F.col("kept").cast("binary"), 256)).collect())


def test_documents(both, rows):
    want = brute(rows)
    assert result(both, chunk_bytes=60_000) == want
    assert result(both) == want
    assert sum(k[2] > 0 for k in want) > 20


def test_a_crowded_sketch_loses_nothing(spark, small):
    """Windows sketched into few cells collide, are all sent to the exact grouping, and the result is the same."""
    rows = [(r["doc_id"], r["text"]) for r in small.where("doc_id < 60").collect()] + [(100, "a b " * 30), (101, "b a " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, chunk_bytes=9000, depth=1, gram=2) == brute(rows)


def test_empty(empty):
    assert substring_dedup.remove_repeated(empty).collect() == []


def test_words_of_a_chunk_are_hashed_together():
    """Word by word, or sorted again for each chunk, the steps took most of the time."""
    bodies = [b"", b" a\tbb  a\x0b", b"\xc3\xa9 \x1c x\r\ny" + b" z" * 40 + b"w" * 40, b"  "]
    w = substring_dedup.Windows(bodies, 4, 2)
    assert w.sizes.tolist() == [len(b.split()) for b in bodies] and not hasattr(w, "words")
    words = [x for b in bodies for x in b.split()]
    assert [words[i : i + 4] for i in w.start] == [x[i : i + 4] for x in map(bytes.split, bodies) for i in range(len(x) - 3)]
    first = {tuple(words[i : i + 4]): w.key[i] for i in w.start}
    assert all(first[tuple(words[i : i + 4])] == w.key[i] for i in w.start) and len(set(first.values())) == len(first)
    assert w.anchor[w.fresh()].tolist() == sorted(set(w.anchor.tolist()))


def test_cells_of_all_chunks_are_sorted_once(monkeypatch):
    rng = np.random.default_rng(1)
    cells = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 5, 80, 40, 0)]
    twice = [rng.random(len(c)) < 0.1 for c in cells]
    count = Counter(x for c, t in zip(cells, twice) for x, y in zip(c.tolist(), t.tolist()) for _ in range(1 + y))
    monkeypatch.setattr(np, "isin", None)
    assert [c.tolist() for c in substring_dedup.repeated_cells(cells, twice)] == [[x for x in c.tolist() if count[x] > 1] for c in cells]
