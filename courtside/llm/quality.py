"""Quality classifier: a support vector machine over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import by_batch, held_out, lean, mixed, narrow, rolling
import xxhash

BITS = 18
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


class _Tokens(dict):
    """word -> (hash of its lower-case form, hash of its form with letters folded to one sign); bounded."""

    def __missing__(self, w: bytes) -> tuple[int, int]:
        if len(self) >= 150_000:
            self.clear()
        shape = _LETTERS.sub(b"a", w)[:16] if len(w) < 40 else b"long"
        v = self[w] = (xxhash.xxh64_intdigest(w.lower(), 1), xxhash.xxh64_intdigest(shape, 2))
        return v


def indicators(body: bytes | None, memo: dict | None = None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct n-gram indices of a whole text: word 1- and 2-grams, and 1- to 3-grams of word forms.

    A word equal to the one before it has a form of its own, so that runs of one word make n-grams whatever the word is.
    """
    memo = _Tokens() if memo is None else memo
    words = (body or b"").split()
    if not words:
        return np.zeros(1, np.int64)                     # one indicator of its own: no words
    both = np.array([memo[w] for w in words], np.uint64)
    word, form = both[:, 0], both[:, 1].copy()
    form[1:][word[1:] == word[:-1]] = np.uint64(7)
    grams = [mixed(word), rolling(word, 2), mixed(form + np.uint64(11)), rolling(form, 2, 0xC2B2AE3D27D4EB4F), rolling(form, 3, 0x165667B19E3779F9)]
    return np.unique(np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7):
    """Weights of the linear hinge-loss model over unit-length rows of `scale` at the rows' indices."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(len(scale) + 1), np.zeros(len(rows))
    values = []
    for x in rows:
        v = scale[x]
        values.append(v / max(np.sqrt(v @ v), 1e-12))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost[i])     # squared length 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    def one(x):
        v = scale[x]
        return (w[x] @ v) / max(np.sqrt(v @ v), 1e-12) + w[-1]

    return np.array([one(x) for x in rows])


def log_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def sigmoid_fit(m: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[s @ (m * m) + 1e-6, s @ m], [s @ m, s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([g @ m, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> dict:
    """Model of a bounded sample. Without both classes every score is the share of the class there is (0.5 without rows)."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        p = 0.5 if not len(y) else float((y[0] + 1) / 2)
        return {"r": np.zeros(1 << bits, np.float32), "w": np.zeros((1 << bits) + 1, np.float32), "a": 0.0, "b": (p - 0.5) * 20}
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    fold = np.arange(len(y)) % 4 == 0
    out = np.zeros(len(y))
    for part in (fold, ~fold):                           # margins of rows that the model has not seen set the sigmoid
        learn = [x for x, p in zip(rows, part) if not p]
        if len(set(y[~part])) < 2:
            continue
        r = log_ratios(learn, y[~part], bits)
        w = dual_coordinate_descent(learn, y[~part], r, cost[~part], epochs=6)
        out[part] = margins([x for x, p in zip(rows, part) if p], r, w)
    a, b = sigmoid_fit(out, y)
    r = log_ratios(rows, y, bits)
    w = dual_coordinate_descent(rows, y, r, cost)
    return {"r": r.astype(np.float32), "w": w.astype(np.float32), "a": a, "b": b}


def sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): of each class, 0 and 1, the `per_class` rows whose hashed ids are least; bounded whatever the input."""
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").distinct()
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, folds: int = 4, fold: int = 2, bits: int = BITS) -> dict:
    """Fit on at most `per_class` labelled documents of each class outside fold `fold`; indices are made on the executors.

    The chosen ids are broadcast, 2 x `per_class` rows at most, so that no text is shuffled.
    """
    chosen = sample(labels.where(~held_out(F.col("doc_id"), folds, fold)), label, per_class)

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        memo = _Tokens()
        x = [indicators(t, memo, bits).astype(np.int32).tobytes() for t in b.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    got = by_batch(narrow(docs).join(F.broadcast(chosen), "doc_id"), digest, "doc_id long, label int, x binary").collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["label"], bytes(r["x"])))
    return fit([np.frombuffer(r["x"], np.int32).astype(np.int64) for r in got], np.array([r["label"] for r in got]), bits)


def score(docs: DataFrame, model: dict, threshold: float = 0.7, bits: int = BITS) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs`; null and empty texts have one indicator and a score as well.

    Repeated rows are scored each; a null id stays null.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)          # 2 x 2^bits floats, whatever the input

    def run(batches):
        memo, m = _Tokens(), held.value
        for b in batches:
            v = margins([indicators(t, memo, bits) for t in b.column("body").to_pylist()], m["r"], m["w"]) if b.num_rows else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(m["a"] * v + m["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return narrow(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: dict, threshold: float = 0.5, text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, all columns as they are; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo, m = _Tokens(), held.value
        for b in batches:
            if b.num_rows:
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                v = margins([indicators(None if t is None else t.encode(), memo, bits) for t in texts], m["r"], m["w"])
                yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(m["a"] * v + m["b"], -30, 30))) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
