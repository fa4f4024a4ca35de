"""Language ID by compression: the language whose zstandard dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import narrow


def train(docs: DataFrame, learn, dict_bytes: int = 110 << 10, per_lang: int = 300, lang: str = "lang", share: int = 4096) -> dict[str, bytes]:
    """A raw-content dictionary of each language: texts of at most `per_lang` documents, least hashed ids first.

    `learn` is the condition on rows to learn from. The first `share` bytes of each chosen text count first, so that many
    texts speak for a language; where these do not fill `dict_bytes`, the rest of the texts follows. Rows without a language,
    an id or a text teach nothing, also where another row of their id does. Only ids and languages are shuffled to choose;
    the at most `per_lang` ids of each language are broadcast back, so no text of another document leaves its task. What
    reaches the driver is bounded by languages, not by documents.
    """
    rows = docs.where(learn).where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col("text").cast("string").cast("binary").alias("body"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = own.select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang)
    size = F.octet_length("body")
    texts = own.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("later", F.explode(F.when(size > share, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    use = F.when(F.col("later"), size - share).otherwise(F.least(size, F.lit(share)))
    until = F.sum(use).over(Window.partitionBy("lang").orderBy("later", "rank", "body"))
    piece = F.when(F.col("later"), F.substring("body", share + 1, dict_bytes)).otherwise(F.substring("body", 1, share))
    got = texts.withColumn("use", use).withColumn("until", until).where(F.col("until") - F.col("use") <= dict_bytes + share).select("lang", "later", "rank", piece.alias("piece"), "body")
    got = got.orderBy("lang", "later", "rank", "body").drop("body").collect()
    out: dict[str, bytes] = {}
    for r in got:
        out[r["lang"]] = (bytes(r["piece"]).decode(errors="ignore").lower().encode() + b"\n" + out.get(r["lang"], b""))[-dict_bytes:]
    return out


def coder(dictionary: bytes, block: int):
    """A compressor for blocks of a text that starts from one language's dictionary, and finds matches of four bytes on."""
    import zstandard

    how = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(dictionary), source_size=block, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, write_content_size=False, write_checksum=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def sizes(text: bytes, coders: list, block: int) -> np.ndarray:
    """Bytes that each language needs for the whole text, block by block, so that its dictionary stays in reach."""
    parts = [text[a : a + block] for a in range(0, len(text), block)]
    return np.array([sum(len(c.compress(p)) for p in parts) for c in coders], float)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.002, block: int = 8192) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; whole texts are encoded, in lower case.

    `und` with score 0 if a text is null or has no letter, or if there is no language. score: the share of the best
    language when each byte more halves a language's weight, tempered by the text's length. rejected: the second language
    is within `margin` of the best, relative to its size. Ties go to the language whose name sorts first.
    """
    names = sorted(dictionaries)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        coders = [coder(held.value[name], block) for name in names]
        for b in batches:
            pred, score, rejected = [], [], []
            for body in b.column("body").to_pylist():
                text = (body or b"").decode(errors="replace")
                if not names or not any(map(str.isalpha, text)):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                n = sizes(text.lower().encode(), coders, block)
                best = int(np.argmin(n))
                gap = (n - n[best]) / (1 + np.sqrt(len(body)) / 64)
                pred.append(names[best]), score.append(float(1 / np.exp2(-gap).sum()))
                rejected.append(bool(np.partition(n, 1)[1] - n[best] < margin * n[best]) if len(n) > 1 else False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return narrow(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
