import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from courtside.llm import packing


def test_pieces_and_places(both, rows):
    got = packing.pack_documents(both).collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = np.zeros(40, np.int64)
        items = rng.integers(3, 39, rng.integers(1, 9)).tolist()
        for i in items:
            counts[i] += 1
        best = max(s for n in range(len(items) + 1) for c in combinations(items, n) if (s := sum(c)) <= 37)
        used = packing.fullest(counts, 37)
        assert sum(n * k for n, k in used) == best
        assert all(k <= counts[n] for n, k in used)


def test_plan_uses_every_piece_once():
    histogram = {5: 1000, 7: 33, 100: 2, 99: 4, 3: 100_000_000}
    total = Counter()
    for used, times in packing.plan(histogram, 100):
        assert sum(n * k for n, k in used) <= 100
        for n, k in used:
            total[n] += k * times
    assert total == histogram


def test_empty(empty):
    assert packing.pack_documents(empty).collect() == []
