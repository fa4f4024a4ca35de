import hashlib
import random

import numpy as np

from courtside.llm import fingerprints


def test_rows_and_next_documents(both, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        n = len(text) // 4
        want.append((doc, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    got = fingerprints.with_next(both, part_bytes=200_000).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=str) == sorted(want, key=str)
    text_of = dict(rows)
    same = {}
    for r in got:
        if r["doc_id"] != 6:
            assert same.setdefault(text_of[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.3


def test_near_against_all_pairs(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(128) for _ in range(40)]
    for _ in range(200):
        x = rng.choice(fps)
        for b in rng.sample(range(128), rng.randint(1, 4)):
            x ^= 1 << b
        fps.append(x)
    text = sorted({f"{x:032x}" for x in fps})
    df = spark.createDataFrame([(x,) for x in text], "fingerprint string")
    some = df.limit(30)
    asked = [r["fingerprint"] for r in some.collect()]
    want = {(q, m, n) for q in asked for m in text if (n := (int(q, 16) ^ int(m, 16)).bit_count()) <= 3}
    for spare in (0, 1):
        got = {tuple(r) for r in fingerprints.near(df, spark.createDataFrame([(q,) for q in asked], "fingerprint string"), 3, spare).collect()}
        assert got == want


def test_empty_and_single(spark, empty):
    assert fingerprints.with_next(empty).collect() == []
    one = fingerprints.with_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(b"abcdefab").hexdigest())
