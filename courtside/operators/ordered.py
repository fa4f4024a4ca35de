"""Ordered computations that do not need a whole key in one task.

A running value over one key is cut into slices (time ranges or ordinal ranges): each
slice is reduced on its own, the few slice totals are scanned per key, and every row
combines its slice's carry with a window inside its slice. A key that holds a third of
all rows is thereby spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

AGGS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def time_slice(ts: Column, unit: str = "day") -> Column:
    return F.date_trunc(unit, ts)


def ordinal_slice(ordinal: Column, width: int = 100_000) -> Column:
    return F.floor(ordinal / width)


def sliced(df: DataFrame, keys: list[str], slice_: Column) -> DataFrame:
    """Adds _key and _slice. The key is one struct, so that null parts compare equal and the
    join with the carries keeps the partitioning the windows need."""
    return df.withColumn("_key", F.struct(*keys)).withColumn("_slice", slice_)


def running(
    df: DataFrame, keys: list[str], order: list[str], slice_: Column, specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum / max / min per key in `order`: specs = {output: (kind, value)}.

    With inclusive=False a row sees only the rows before it. The rows are shuffled once.
    """
    src = sliced(df, keys, slice_)
    for name, (_, value) in specs.items():
        src = src.withColumn(f"_v_{name}", value)
    totals = src.groupBy("_key", "_slice").agg(
        *[AGGS[kind][0](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in specs.items()]
    )
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        "_key", "_slice",
        *[AGGS[kind][0](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in specs.items()],
    )
    joined = src.join(carries, ["_key", "_slice"])
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    for name, (kind, _) in specs.items():
        agg, merge = AGGS[kind]
        joined = joined.withColumn(name, merge(agg(f"_v_{name}").over(inside), F.col(f"_c_{name}")))
    return joined.drop("_key", "_slice", *[f"_v_{n}" for n in specs], *[f"_c_{n}" for n in specs])


def last_known(
    df: DataFrame, keys: list[str], order: list[str], slice_: Column, value: Column, out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Latest non-null `value` per key at (or, if not inclusive, before) each row."""
    src = sliced(df, keys, slice_).withColumn("_v", value)
    # every slice of the key needs a row here, also one without a value of its own
    slots = src.groupBy("_key", "_slice").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v"))).alias("_t"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carries = slots.select("_key", "_slice", F.last("_t._v", ignorenulls=True).over(before).alias("_c"))
    joined = src.join(carries, ["_key", "_slice"])
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    seen = F.last("_v", ignorenulls=True).over(inside)
    return joined.withColumn(out, F.coalesce(seen, F.col("_c"))).drop("_key", "_slice", "_v", "_c")


def first_rows(df: DataFrame, by: list[str], order: list[Column | str], k: int | None, rank: str = "rn") -> DataFrame:
    """First k rows per group, ranked; all of them if k is None. Spark cuts each task to k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def best_row(df: DataFrame, by: list[str], score: list[Column]) -> DataFrame:
    """The row with the greatest score per key, nulls least; any of them on ties.

    Each task is cut to one row per key before the shuffle, however often a key comes. Rows are sorted by
    reference and not aggregated: a struct of the whole row as an aggregate would be copied at every step.
    """
    return first_rows(df, by, [c.desc() for c in score], 1, "_place").drop("_place")
