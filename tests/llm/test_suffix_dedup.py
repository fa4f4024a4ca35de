import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from courtside.llm import suffix_dedup


def brute(rows, width=200):
    count = Counter()
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for _, b in bodies:
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = Counter()
    for d, b in bodies:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[max(i, end) : i + width] = b"\1" * (i + width - max(i, end))
                end = i + width
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def result(df, **how):
    out = suffix_dedup.remove_repeated(df, **how)
    n = F.aggregate("removed", F.lit(0), lambda n, s: n + s["length"])
    return Counter(tuple(r) for r in out.select("doc_id", "n_bytes", n, F.size("removed"), F.sha2("kept", 256)).collect())


def test_documents(both, rows):
    want = brute(rows)
    assert result(both, chunk_bytes=100_000) == want
    assert result(both) == want
    assert sum(k[2] > 0 for k in want) > 20


def test_edited_copies(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = []
    for d in range(80):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        a = rng.randrange(600)
        rows.append((d, "".join(t)[a : a + rng.randint(150, 1400)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, chunk_bytes=20_000) == brute(rows)
    assert result(df, width=40, gram=10, chunk_bytes=20_000) == brute(rows, 40)


def test_maximal_repeats_against_all_substrings():
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(2, 40)))
        b = np.frombuffer(text.encode(), np.uint8)
        start = np.arange(len(b))
        order, shared = suffix_dedup.suffix_array(b, start, len(b) - start)
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
        left = np.where(order > 0, b[np.maximum(order - 1, 0)].astype(np.int64), -1)
        got = {(n, tuple(sorted(order[lo:hi].tolist()))) for n, lo, hi in suffix_dedup.maximal_repeats(shared, left, 2)}
        places = defaultdict(list)
        for i in range(len(text)):
            for n in range(2, len(text) - i + 1):
                places[text[i : i + n]].append(i)
        want = set()
        for s, at in places.items():
            before = {text[i - 1] if i else None for i in at}
            after = {text[i + len(s)] if i + len(s) < len(text) else None for i in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                want.add((len(s), tuple(at)))
        assert got == want


def test_groups_hold_equal_strings(small):
    groups = suffix_dedup.repeat_groups(small, chunk_bytes=100_000).collect()
    size = Counter((r["shard"], r["repeat"]) for r in groups)
    assert size and min(size.values()) > 1 and min(r["length"] for r in groups) >= 200


def test_empty(empty):
    assert suffix_dedup.remove_repeated(empty).collect() == []
