import re

from courtside.llm import decontamination
from courtside.llm.common import table

from .conftest import SF


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in rows:
        w, hit, own = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    own |= windows[k]
        out.append((doc, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


def test_against_brute_force(spark, both, rows):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    items += [(900, "One; two"), (901, None), (902, ""), (903, "x x x x x x x x x x x x"), (900, "the same words again and again until they are more"), (904, "東京")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    got = decontamination.decontaminate(both, bench)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()], key=str) == want
    got = decontamination.decontaminate(both, bench, block_bytes=2000)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()], key=str) == want
    assert sum(1 for r in want if r[2]) > 5
    kept = decontamination.drop_contaminated(both, bench)
    hit = {r[0] for r in want if r[2]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in hit)


def test_longest_match_goes_on_beyond_a_window(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of it")], "doc_id long, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame([(5, f"other {text} end")], "item_id long, text string"))
    match = {r["doc_id"]: r["matches"] for r in got.collect()}
    assert [tuple(m) for m in match[1]] == [("5", 1, 1, 30)] and not match[2]


def test_empty(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(empty, none).collect() == []
    assert all(r["n_hit"] == 0 for r in decontamination.decontaminate(odd, none).collect())
