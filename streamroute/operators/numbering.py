"""Row numbers in arrival order without gathering a key's rows in one task.

Arrival numbers are cut into blocks. Rows are counted per (key, block), the counts are summed up over the blocks of a
key (few rows), and rows are ranked only within their block; so a key that holds most rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Arrival numbers a block spans.
BLOCK = 1 << 18


def number_rows(df: DataFrame, keys: list[str], seq: str, name: str = "rn", block: int = BLOCK) -> DataFrame:
    """df plus the 1-based position of each row among its keys' rows by `seq` (unique, integer). Null keys form one
    group each; rows with equal seq are numbered in no defined order."""
    cut = df.withColumn("__b", F.floor(F.col(seq) / F.lit(block)))
    per = cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__b").alias("__ob"), before.alias("__before"))
    ranked = cut.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(seq)))
    on = F.col("__b").eqNullSafe(F.col("__ob"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    out = ranked.join(offsets, on, "left").withColumn(name, F.col("__before") + F.col("__r"))
    return out.drop("__b", "__r", "__ob", "__before", *[f"__o_{k}" for k in keys])


def last_n(df: DataFrame, n: int, seq: str, keys: list[str] | None = None) -> DataFrame:
    """The last n rows by seq, overall or per key (bounded cache that evicts the oldest)."""
    if not keys:
        return df.orderBy(F.col(seq).desc_nulls_last()).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc_nulls_last())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def by_priority(df: DataFrame, keys: list[str], priority: str, seq: str, name: str = "rn", block: int = BLOCK) -> DataFrame:
    """df plus the position of each row among its keys' rows when higher priorities go first and equal ones by `seq`. Null
    priorities go last. Rows are numbered per priority, and offset by the counts of the higher ones (few rows)."""
    level = df.withColumn("__p", F.coalesce(F.col(priority), F.lit(-(2**31))))
    own = number_rows(level, [*keys, "__p"], seq, "__own", block)
    counts = level.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    above = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"__q_{k}") for k in keys], F.col("__p").alias("__q"), above.alias("__above"))
    on = F.col("__p") == F.col("__q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
    return own.join(offsets, on, "left").withColumn(name, F.col("__above") + F.col("__own")).drop("__p", "__q", "__own", "__above", *[f"__q_{k}" for k in keys])
