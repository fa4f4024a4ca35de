import random
import re
from collections import Counter

import xxhash
from courtside.llm import near_dedup


def brute_fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return [least[find(i)] for i in range(len(fps))]


def test_documents(both, rows):
    fps = [(doc, brute_fingerprint(text)) for doc, text in rows]
    want = Counter((doc, f"{fp:016x}", c) for (doc, fp), c in zip(fps, brute_components(fps)))
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(both).collect()) == want


def test_links_against_all_pairs(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0}
    for _ in range(400):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for per_part in (8, 1000):
        links = near_dedup.ball_links(df, 4, per_part)
        roots = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
        want = dict(zip(signed, brute_components([(x, x & (2**64 - 1)) for x in signed])))
        assert {x: roots.get(x, x) for x in signed} == want


def test_one_of_each_group_stays(both):
    named = near_dedup.near_duplicates(both).collect()
    kept = near_dedup.keep_first(both)
    assert kept.columns == both.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in named} | {None}


def test_empty(empty):
    assert near_dedup.near_duplicates(empty).collect() == []
