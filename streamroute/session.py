"""Session helpers: shared folder, materialised tables, size-checked joins."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may hold to be broadcast (both are measured, never guessed).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Ways the larger side of a hot key is split when the other side is too large to broadcast.
JOIN_SALTS = 32
#: Rows of a key from which on join_counted splits it, and how many keys it splits at most (those with most rows).
HOT_ROWS, HOT_KEYS = 100_000, 1_000


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("streamroute")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where the session names none, a local master (tests, all in one process) gets a temporary folder; on any other
    master that is an error, since a folder of the driver's machine isn't shared.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="streamroute-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back; cuts the lineage and survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _small_enough(small: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """Rows and bytes of a side, read only until max_rows are passed."""
    size = F.lit(0).cast("bigint")
    for f in small.schema.fields:
        c, kind = F.col("`" + f.name.replace("`", "``") + "`"), f.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + F.lit(8)
    n = small.limit(max_rows + 1).select(size.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return n["n"] <= max_rows and n["b"] <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that Spark mustn't broadcast: it goes by the files' size, which says little about the rows in memory."""
    return df.hint("merge")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, salts: int = JOIN_SALTS, max_bytes: int | None = None) -> DataFrame:
    """Join against a side that is usually small.

    The small side's rows and bytes are counted (reading stops past max_rows); up to max_rows and max_bytes (BROADCAST_BYTES)
    it is broadcast. Beyond that both sides shuffle, hot keys of the big side being spread by their tasks over `salts` copies
    of the small side's rows.
    how: inner, left, left_semi or left_anti.
    """
    if _small_enough(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(shuffled(copies), [*on, "__salt"], how).drop("__salt")


def join_counted(big: DataFrame, small: DataFrame, on: list[str], n: str, how: str = "inner", max_rows: int = 20_000, max_bytes: int = 4 << 20, hot_rows: int = HOT_ROWS, salts: int = JOIN_SALTS) -> DataFrame:
    """Join against a side of one row a key that tells in column n how many rows of the big side have its key (n is dropped).

    As join_small, but beyond max_rows and max_bytes only keys of more than hot_rows rows get `salts` copies; all others
    have one. So the shuffle is about both sides' size, and the driver gets the names of HOT_KEYS keys at most.
    how: inner, left, left_semi or left_anti.
    """
    if _small_enough(small.drop(n), max_rows, max_bytes):
        return big.join(F.broadcast(small.drop(n)), on, how)
    hot = F.broadcast(small.where(F.col(n) > hot_rows).orderBy(F.desc(n), *on).limit(HOT_KEYS).select(*on, F.lit(True).alias("__hot")))
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    lane = F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int")
    salted = big.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot") | null, lane).otherwise(F.lit(0))).drop("__hot")
    lanes = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = small.drop(n).join(hot, on, "left").withColumn("__salt", F.explode(lanes)).drop("__hot")
    return salted.join(shuffled(copies), [*on, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df itself where its scan has enough partitions for all cores; else redistributed, for maps that cost far more
    than a shuffle of their input. Tables of many files or splits are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path on any file system that Spark can use."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(spark: SparkSession, path: str) -> bool:
    """Was a table written whole to this path?"""
    fs, at = hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, [] where there is none."""
    fs, at = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
