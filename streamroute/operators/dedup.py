"""Exactly one copy of messages that were delivered more than once.

Rows are partitioned by their identifier, ranked by arrival with a deterministic tie-break, and the first is kept.
New batches are anti-joined against the identifiers stored by earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamroute.operators.bloom import Bloom
from streamroute.session import children, join_counted, join_small, materialize, written


def _salts(spark: SparkSession) -> int:
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _hashable(df: DataFrame, column: str) -> bool:
    return not any(t in df.schema[column].dataType.simpleString() for t in ("map<", "variant"))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order. Rows with a null key part equal nothing and are all kept.

    The rank filter is applied before the shuffle as well (group limit), so a key that holds most rows sends one row a
    task. Exactly repeated rows: one stays.
    """
    tmp = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(tmp, keys)))
    null = F.lit(False)
    for t in tmp:
        null = null | F.col(t).isNull()
    w = Window.partitionBy(*tmp).orderBy(*order)
    first = keyed.where(~null).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", *tmp)
    # rows without a key need no shuffle; numbering them apart instead would depend on the order they are read in
    return first.unionByName(keyed.where(null).drop(*tmp))


def mark_copies(df: DataFrame, keys: list[Column], order: list[Column], flag: str = "is_copy", salts: int | None = None) -> DataFrame:
    """df plus a flag: true for every row but the first of its key in the given order.

    Ranked twice: within (key, salt), then the first rows of the salts within the key. No task ever sorts more than a
    salt's share of one key; the second rank sees at most `salts` rows of it. Rows with a null key part are spread by
    their salt and never flagged. Of exactly repeated rows all but one are flagged.
    """
    n = salts or _salts(df.sparkSession)
    tmp = [f"__k{i}" for i in range(len(keys))]
    out = df.withColumns(dict(zip(tmp, keys)))
    null = F.lit(False)
    for t in tmp:
        null = null | F.col(t).isNull()
    # from the row's content and its task, not from its place: a task that is run again gives every row the same salt
    out = out.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)], F.spark_partition_id()), F.lit(n)))
    first = Window.partitionBy(*tmp, "__salt").orderBy(*order)
    out = out.withColumn("__rn", F.row_number().over(first))
    # rows already ranked behind keep their salt, so that they don't gather under the key
    out = out.withColumn("__lane", F.when((F.col("__rn") > 1) | null, F.col("__salt")).otherwise(F.lit(-1)))
    second = Window.partitionBy(*tmp, "__lane").orderBy(*order)
    out = out.withColumn("__rn2", F.row_number().over(second))
    copy = ~null & ((F.col("__rn") > 1) | (F.col("__rn2") > 1))
    return out.withColumn(flag, copy).drop(*tmp, "__salt", "__rn", "__lane", "__rn2")


def fresh_rows(batch: DataFrame, stored: DataFrame, keys: list[Column], order: list[Column], names: list[str]) -> DataFrame:
    """Rows of a batch to keep: the first of each key whose key isn't among the stored identifiers (columns `names`).

    Stored identifiers are distinct, so the anti join has one row a key on either side and no hot key.
    """
    first = keep_first(batch, keys, order).withColumns(dict(zip(names, keys)))
    return first.join(stored.select(*names), names, "left_anti")


MODES = ("memory", "balanced", "durable")


def _repeats_in_batch(batches: Iterator) -> Iterator:
    """Before the shuffle: which rows repeat a key of their Arrow batch. They are spread by their number."""
    import pyarrow as pa

    for batch in batches:
        h, seq = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        order = np.lexsort((seq, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, seq, again, np.where(again, seq, h))], names=["h", "seq", "again", "lane"])


def tiered(df: DataFrame, key: Column, seq: str, mode: str = "durable", capacity: int = 1_000_000, rate: float = 0.001) -> DataFrame:
    """df plus `status`, stored or duplicate, in the order of `seq` (unique, integer).

    First tier: keys are hash-partitioned to Bloom filters of `capacity` keys at `rate`, which tell surely new keys from
    those that may have been seen. In the modes 'memory' and 'balanced' that is all: what may have been seen is a
    duplicate, so at most about `rate` of the new rows are lost. In 'durable' the second tier, the first number of
    each key, is asked for these rows only, and nothing is lost. Rows without key or number are stored.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    own = df.withColumn("__key", key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = own.where(F.col("__key").isNotNull() & F.col(seq).isNotNull()).select(F.xxhash64("__key").alias("h"), F.col(seq).cast("bigint").alias("seq"))
    lanes = ids.mapInArrow(_repeats_in_batch, "h bigint, seq bigint, again boolean, lane bigint").repartition(parts, "lane")

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bloom = None
        for batch in batches:
            bloom = bloom or Bloom(capacity, rate)
            h, seqs, maybe = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            h, maybe = h.astype(np.int64).view(np.uint64), maybe.astype(bool).copy()
            at = np.flatnonzero(~maybe)
            first = np.zeros(len(at), bool)
            first[np.unique(h[at], return_index=True)[1]] = True
            maybe[at] = bloom.may_contain(h[at]) | ~first
            bloom.insert(h[at[~maybe[at]]])
            yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array(maybe)], names=["__seq", "__maybe"])

    asked = materialize(lanes.sortWithinPartitions("seq", "h").mapInArrow(ask, "__seq bigint, __maybe boolean"), "bloom-answers")
    out = own.join(asked, F.col(seq) == F.col("__seq"), "left").drop("__seq").withColumn("__maybe", F.coalesce("__maybe", F.lit(False)))
    if mode == "durable":
        unsure = out.where("__maybe").select("__key").distinct()
        firsts = join_small(own.select("__key", F.col(seq).alias("__n")), unsure, ["__key"], "left_semi").groupBy("__key").agg(F.min("__n").alias("__first"))
        out = join_small(out, firsts, ["__key"], "left")
        out = out.withColumn("__maybe", F.col("__maybe") & (F.col(seq) != F.col("__first"))).drop("__first")
    return out.withColumn("status", F.when(F.col("__maybe"), "duplicate").otherwise("stored")).select(*[F.col(f"`{c}`") for c in df.columns if c != "status"], "status")


def checks_before_inserts(df: DataFrame, key: Column, batch: str) -> DataFrame:
    """df plus `status` as a pipeline gives it that checks a whole batch before it inserts any of it: rows of a key's
    first batch are all stored, copies within it too; rows of later batches are duplicates. Rows without key or batch
    are stored. (keep_first and mark_copies don't have that hole.)"""
    own = df.withColumn("__key", key)
    first = own.where("__key is not null").groupBy("__key").agg(F.min(batch).alias("__first"), F.max(batch).alias("__last"), F.count(F.lit(1)).alias("__n"))
    # keys of one batch have no late rows; the join doesn't need them
    first = materialize(first.where("__first < __last").drop("__last"), "repeated-keys")
    late = F.coalesce(F.col(batch) > F.col("__first"), F.lit(False))
    return join_counted(own, first, ["__key"], "__n", "left").withColumn("status", F.when(late, "duplicate").otherwise("stored")).select(*[F.col(f"`{c}`") for c in df.columns if c != "status"], "status")


class SeenStore:
    """Identifiers seen so far, one folder a batch, in a shared path.

    ``take(batch_no, df)`` gives the rows to keep and stores their identifiers. Taking a batch again (after a failure)
    gives the same rows: its own folder is left out of the anti join and written anew.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[Column], order: list[Column], names: list[str]):
        self.spark, self.path, self.keys, self.order, self.names = spark, path.rstrip("/"), keys, order, names

    def stored(self, before: int) -> DataFrame | None:
        names = [n for n in children(self.spark, self.path) if n.startswith("batch=") and int(n[6:]) < before]
        done = [f"{self.path}/{n}" for n in names if written(self.spark, f"{self.path}/{n}")]
        return self.spark.read.parquet(*done).select(*self.names) if done else None

    def take(self, batch_no: int, df: DataFrame) -> DataFrame:
        stored = self.stored(batch_no)
        if stored is None:
            out = keep_first(df, self.keys, self.order).withColumns(dict(zip(self.names, self.keys)))
        else:
            out = fresh_rows(df, stored, self.keys, self.order, self.names)
        target = f"{self.path}/batch={batch_no}"
        whole = F.lit(True)
        for n in self.names:
            whole = whole & F.col(n).isNotNull()
        out.where(whole).select(*self.names).write.mode("overwrite").parquet(target)
        return out
