"""Joins of word sets by the share of the smaller set that the larger one holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from courtside.session import spread

NEAR = 1e-9


def set_text(words: str) -> Column:
    """A word set as one text, in the set's own order."""
    return F.concat_ws(" ", words)


def _rare_first(sets: DataFrame, keys: list[str], n: DataFrame) -> DataFrame:
    """keys, _k, _ws: each distinct set with its words in order of rarity."""
    words = sets.select(*keys, set_text("words").alias("_k"), "words").distinct().select(*keys, "_k", F.explode("words").alias("_w"))
    ranked = words.join(spread(n), [*keys, "_w"]).groupBy(*keys, "_k").agg(F.sort_array(F.collect_list(F.struct("_n", "_w"))).alias("_ws"))
    return ranked.select(*keys, "_k", F.transform("_ws", lambda x: x["_w"]).alias("_ws"))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], at_least: float) -> DataFrame:
    """(keys…, lk, rk, share) of the distinct sets that share `at_least` of the smaller one's words, and one at least.

    left, right: keys and `words`, an array without repeats; `lk` and `rk` are `set_text` of the pair. Words are ordered
    from rare to frequent inside a key. Of a set of s words that is the smaller one, c = ceil(at_least · s) must be in
    the other, so one of its s - c + 1 rarest is: only these are looked up among all words of larger sets. A frequent
    word is looked up only by sets that have hardly any other. A pair is verified once, at the first word it shares.
    """
    if at_least > 1:
        at_least = 2.0                                                    # nothing shares more than all
    words = left.select(*keys, "words").unionByName(right.select(*keys, "words")).distinct()
    n = words.select(*keys, F.explode("words").alias("_w")).groupBy(*keys, "_w").agg(F.count("*").alias("_n"))
    a, b = _rare_first(left, keys, n), _rare_first(right, keys, n)
    size = F.size("_ws")
    need = F.greatest(F.lit(1), F.ceil(size * at_least - NEAR)).cast("int")

    def looked_up(small: DataFrame, large: DataFrame, fits) -> DataFrame:
        heads = small.where(need <= size).select(*keys, F.col("_k").alias("_sk"), F.col("_ws").alias("_s"), F.explode(F.slice("_ws", F.lit(1), size - need + 1)).alias("_w"))
        full = large.select(*keys, F.col("_k").alias("_gk"), F.col("_ws").alias("_g"), F.explode("_ws").alias("_w"))
        both = F.array_intersect("_s", "_g")
        share = F.size(both).cast("double") / F.size("_s")
        met = heads.join(spread(full), [*keys, "_w"]).where(fits(F.size("_s"), F.size("_g")) & (F.get(both, F.lit(0)) == F.col("_w")))
        return met.withColumn("share", share).where(F.col("share") >= at_least - NEAR)

    return looked_up(a, b, lambda s, g: s <= g).select(*keys, F.col("_sk").alias("lk"), F.col("_gk").alias("rk"), "share").unionByName(
        looked_up(b, a, lambda s, g: s < g).select(*keys, F.col("_gk").alias("lk"), F.col("_sk").alias("rk"), "share")
    )
