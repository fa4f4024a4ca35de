import pytest

from courtside.llm.common import table

SF = "/root/testdata/sf0.001"
#: Empty, null, blank, very long, repeated, tied and odd texts; some ids repeat, one is null.
ODD = [
    (1, ""), (2, None), (3, " \n \t "), (4, "word"), (5, "word"), (6, "one two three"), (6, "one two three"), (7, "A b\x00c D e f  g\n\nh <|endoftext|> i's"),
    (8, "the same words again and again until they are more than twenty of them in all so that a window fits in here twice " * 3),
    (9, "the same words again and again until they are more than twenty of them in all so that a window fits in here twice"),
    (10, "x " * 30000), (11, "ÉÀ 東京 ß 😀 İ mixed Ωmega Text"), (12, "|".join(["&&&"] * 50)), (13, "a" * 5000), (14, "a" * 450), (15, "ab" * 300), (None, "a row without an id"), (-3, "word"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with those that operators use."""
    rows = [(i, t, None if i == 2 else "en", "src0", None if t is None else len(t), "x", 1, b"y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, part int, body binary")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def both(odd, small):
    """The odd rows and the smallest documents, ids of the latter moved up."""
    return odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(small.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")).cache()


@pytest.fixture(scope="session")
def rows(both):
    return [(r["doc_id"], r["text"]) for r in both.select("doc_id", "text").collect()]
