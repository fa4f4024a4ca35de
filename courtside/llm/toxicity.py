"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import WordHashes, by_batch, held_out, narrow
from courtside.llm.quality import sigmoid_fit

_WORD = re.compile(r"\w+")


def word_set(body: bytes | None, memo: WordHashes) -> np.ndarray:
    """Distinct hashes of the lower-cased words of a whole text."""
    return np.unique(memo.of([w.encode() for w in _WORD.findall((body or b"").decode(errors="replace").lower())]))


def vocabulary(rows: list[np.ndarray], y: np.ndarray, most: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The `most` words with the greatest chi-square against the label, in hash order, and the smoothed log-ratio of each."""
    words, index = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint64), return_inverse=True)
    label = np.repeat(y, [len(r) for r in rows])
    a = np.bincount(index, label, len(words))
    n = np.bincount(index, minlength=len(words)).astype(float)
    pos, total = y.sum(), len(y)
    expected = n * pos / max(total, 1)
    chi = (a - expected) ** 2 / np.maximum(expected * (1 - pos / max(total, 1)) * np.maximum(1 - n / max(total, 1), 1e-9), 1e-9)
    chi[n < least] = 0
    keep = np.sort(np.argsort(-chi, kind="stable")[:most])
    keep = keep[chi[keep] > 6.63]                                       # one in a hundred by chance
    ratio = np.log((a[keep] + 0.5) / (pos + 1)) - np.log((n[keep] - a[keep] + 0.5) / (total - pos + 1))
    return words[keep], ratio


def features(row: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.searchsorted(words, row)
    at[at == len(words)] = 0
    return at[words[at] == row] if len(words) else at[:0]


def logistic(x: list[np.ndarray], extra: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = 1.0, rounds: int = 300):
    """Weights by accelerated gradient steps: of `scale`d word indicators, of the extra columns, and the constant."""
    size, m = len(scale), len(scale) + extra.shape[1] + 1
    row, col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    val = scale[col]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    bound = (np.bincount(row, val * val, len(x)) + (extra * extra).sum(1) + 1).max() if len(x) else 1.0
    step = 1 / (0.25 * bound * weight.sum() + ridge)
    w = v = np.zeros(m)
    for k in range(rounds):
        z = np.bincount(row, val * v[col], len(x)) + extra @ v[size : m - 1] + v[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.r_[np.bincount(col, val * g[row], size), extra.T @ g, g.sum()] + ridge * np.r_[v[:-1], 0]
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def margins(x: list[np.ndarray], extra: np.ndarray, link: dict) -> np.ndarray:
    w, size = link["w"], len(link["words"])
    own = np.array([w[i] @ link["ratio"][i] for i in x]) if x else np.zeros(0)
    return own + extra @ w[size:-1] + w[-1]


def one_link(rows, extra, y, most: int) -> dict:
    words, ratio = vocabulary(rows, y, most)
    x = [features(r, words) for r in rows]
    return {"words": words, "ratio": ratio, "w": logistic(x, extra, y, ratio), "a": 1.0, "b": 0.0}


def probability(rows, extra, link: dict) -> np.ndarray:
    if link.get("constant") is not None:
        return np.full(len(rows), link["constant"])
    m = margins([features(r, link["words"]) for r in rows], extra, link)
    return 1 / (1 + np.exp(-np.clip(link["a"] * m + link["b"], -30, 30)))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = 4, most: int = 4000) -> list[dict]:
    """A link for each column of `labels`. What a link sees of the earlier ones comes from models of the other folds."""
    fold, extra, links = np.arange(len(rows)) % folds, np.zeros((len(rows), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        if not len(y) or y.min() == y.max():
            links.append({"constant": float(y[0]) if len(y) else 0.0})
            extra = np.c_[extra, np.full(len(rows), links[-1]["constant"])]
            continue
        out = np.zeros(len(rows))
        for f in range(folds):
            learn = np.flatnonzero(fold != f)
            test = np.flatnonzero(fold == f)
            if y[learn].min() == y[learn].max():
                continue
            link = one_link([rows[i] for i in learn], extra[learn], y[learn], most)
            out[test] = margins([features(rows[i], link["words"]) for i in test], extra[test], link)
        link = one_link(rows, extra, y, most)
        link["a"], link["b"] = sigmoid_fit(out, np.where(y > 0, 1.0, -1.0))
        links.append(link)
        extra = np.c_[extra, 1 / (1 + np.exp(-np.clip(link["a"] * out + link["b"], -30, 30)))]
    return links


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), per_class: int = 1500, folds: int = 4, fold: int = 3) -> list[dict]:
    """Fit on a sample of labelled documents outside fold `fold`: of each combination of categories at most `per_class`.

    Rows without an id or with a category other than 0 and 1 teach nothing. The chosen ids are broadcast, `per_class` rows
    of each combination at most, so that no text is shuffled; the driver gets the word hashes of the sample alone.
    """
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna().where(reduce(and_, [F.col(c).isin(0, 1) for c in categories])).distinct()
    rank = F.row_number().over(Window.partitionBy(*categories).orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = seen.where(~held_out(F.col("doc_id"), folds, fold)).withColumn("rank", rank).where(F.col("rank") <= per_class)

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        memo = WordHashes()
        x = [word_set(t, memo).tobytes() for t in b.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary())] + [b.column(c) for c in categories], ["doc_id", "x", *categories])

    schema = "doc_id long, x binary, " + ", ".join(f"{c} int" for c in categories)
    got = by_batch(narrow(docs).join(F.broadcast(chosen), "doc_id"), digest, schema).collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), bytes(r["x"])))
    return fit_chain([np.frombuffer(r["x"], np.uint64) for r in got], np.array([[r[c] for c in categories] for r in got]).reshape(len(got), len(categories)))


def predict(docs: DataFrame, links: list[dict], categories: tuple[str, ...] = ("low_quality", "toxic")) -> DataFrame:
    """(doc_id, p_<category> ...) of every row, whole texts; null and empty texts have no words and the chain's base rates."""
    held = docs.sparkSession.sparkContext.broadcast(links)

    def run(batches):
        memo = WordHashes()
        for b in batches:
            rows = [word_set(t, memo) for t in b.column("body").to_pylist()]
            extra = np.zeros((len(rows), 0))
            for link in held.value:
                extra = np.c_[extra, probability(rows, extra, link)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(extra[:, k], pa.float64()) for k in range(extra.shape[1])], ["doc_id", *[f"p_{c}" for c in categories]])

    return narrow(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories))
