"""Per-key results when a few keys hold most rows.

Every aggregate here is algebraic: tasks combine their rows into one mergeable state a key (Spark's hash aggregate,
which spills to sorted runs when its bounded table is full) and only these states are shuffled, so the largest key
costs one row a task. Distinct counts go through (key, value) states first. Nothing is capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_keys(df: DataFrame, keys: list[str], states: dict[str, Column]) -> DataFrame:
    """groupBy over algebraic aggregates (count, sum, min, max, avg, min_by ...). Null keys form one group, as in SQL."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in states.items()])


def distinct_per_key(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Exact number of distinct non-null values a key; (key, value) pairs are hashed apart before they are counted."""
    pairs = df.select(*keys, value.alias("__v")).groupBy(*keys, "__v").agg(F.lit(1).alias("__one"))
    return pairs.groupBy(*keys).agg(F.count("__v").alias(name))


def heavy_keys(df: DataFrame, scope: str, key: str, share: float) -> DataFrame:
    """Keys holding at least `share` of all rows of their scope: scope, key, n_rows, scope_rows.

    Rows with a null or empty key count towards their scope but are no key. The two aggregates read the same shuffled
    states; the scopes (tables) are few by definition and joined as broadcast after their rows were summed.
    """
    counts = aggregate_keys(df, [scope, key], {"n_rows": F.count(F.lit(1))})
    totals = counts.groupBy(scope).agg(F.sum("n_rows").alias("scope_rows"))
    # the test on the key is part of a condition over both sides, so it isn't pushed below the shuffle that both sides read
    n = F.when(F.col(key).isNotNull() & (F.col(key) != ""), F.col("n_rows")).otherwise(-1)
    return counts.join(totals, scope).where(n >= F.lit(share) * F.col("scope_rows"))


def index_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Percentiles by index, ``sorted[int(n*q)]``, exactly, from (key, value) counts.

    Only counts are shuffled; the running sum per key sees each distinct value once.
    """
    from pyspark.sql import Window

    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    run = hist.withColumn("__upto", F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__all", F.sum("__n").over(w))
    aggs = []
    for name, q in qs.items():
        at = F.least(F.floor(F.col("__all") * F.lit(q)), F.col("__all") - 1)
        aggs.append(F.min(F.when(F.col("__upto") > at, F.col(value))).alias(name))
    return run.groupBy(*keys).agg(*aggs)
