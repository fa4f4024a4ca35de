"""Groups against sets of end offsets, the query against whole-text encoding by both libraries and plain counting."""

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from courtside.llm import alignment
from courtside.llm.queries import QUERIES

from .conftest import SF


def byte_letters():
    """The letters that stand for bytes in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in own]
    return {chr(c): i for i, c in [(i, i) for i in own] + [(i, 256 + k) for k, i in enumerate(rest)]}


A, B, LETTERS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_letters()
A.encode_special_tokens = True


def plain(text):
    """Groups of one text as two lists of ids each."""
    raw = (" " + text).encode() if text else b""
    x, y = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
    bx = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in x]
    by = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(B.id_to_piece, y)]
    if not raw or b"".join(bx) != raw or b"".join(by) != raw:
        return []
    ends = [np.cumsum([len(t) for t in side]).tolist() for side in (bx, by)]
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in shared]
    for side, (ids, places) in enumerate(zip((x, y), ends)):
        for i, e in zip(ids, places):
            groups[bisect_left(shared, e)][side].append(i)
    return groups


def brute(rows):
    all_groups = [plain(t) for _, t in rows]
    linked = [Counter((i, j) for g in groups for i in g[0] for j in g[1]) for groups in all_groups]
    count = Counter(p for c in linked for p in c)
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (d, _), groups, c in zip(rows, all_groups, linked):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(t for p, t in c.items() if count[p] == most[p[0]])
        out.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()), best, sum(t * count[p] for p, t in c.items()), text))
    return out


def test_diagonals():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randrange(1, 80)
        keep = rng.choice([0.3, 0.6, 0.95])
        a, b = ([i for i in range(1, n) if rng.random() < keep] + [n] for _ in range(2))
        if rng.random() < 0.5:
            b = sorted(set(b) | set(a[3:40]))
            a = sorted(set(a) | set(b[2:50]))
        rows = alignment.diagonals(np.array(a), np.array(b))
        got = [(i + k, j + k) for i, j, m in rows.tolist() for k in range(m)]
        assert got == [(a.index(e), b.index(e)) for e in sorted(set(a) & set(b))]


def test_large_groups():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    cut_a, cut_b = np.array([1, 4, 290, 300]), np.array([2, 3, 180, 200])
    want = Counter()
    for (p, q), (r, s) in zip(zip([0, *cut_a], cut_a), zip([0, *cut_b], cut_b)):
        want.update(int(x) * 7 + int(y) for x in a[p:q] for y in b[r:s])
    for large in (1, 50, 10**9):
        got = Counter()
        group, key, times = alignment.links(a, b, cut_a, cut_b, 7, large)
        for k, n in zip(key.tolist(), times.tolist()):
            got[k] += n
        assert got == want and (np.diff(group) >= 0).all()


def test_rows(odd, both, rows, empty):
    texts = ["▁ marks", "tabs\tand  two spaces ", " lead", "ﬁ ½ é", " ", "\n", "a\r\nb"]
    more = both.select("doc_id", "text").unionByName(both.sparkSession.createDataFrame([(9000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    want = brute(rows + [(9000 + k, t) for k, t in enumerate(texts)])
    for chunk_bytes in (8 << 20, 20_000):
        out = alignment.align(more, chunk_bytes=chunk_bytes)
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows + [(0, t) for t in texts]))
    assert alignment.align(odd).columns == out.columns and alignment.align(odd).count() == odd.count()
    assert alignment.align(empty).collect() == []


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op12_tokenizer_alignment"](spark, SF)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in brute(rows)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
