"""Processing only what was added or changed since the last successful run.

A partition's fingerprint is its row count and the sums of the two halves of its rows' hashes: additive, so it merges
in any order and needs no sort. Fingerprints are stored by every run. Partitions whose fingerprint is as it was are
left alone; the others are recomputed and replaced, each atomically, by dynamic partition overwrite.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute.operators.groups import stable_hash
from streamroute.session import children, join_small, shared_dir, written

FINGERPRINT = ["fp_rows", "fp_high", "fp_low"]
#: Folder name of a partition and the mark of rows that only hold a partition's place.
PART, PLACE = "part__", "place__"
#: Source rows from which a partition is written by a further task.
LANE_ROWS = 5_000_000


def row_hash(columns: list[str]) -> Column:
    """60-bit hash of a row, the same in any engine with MD5. Every value is written with its length and nulls as a
    dash, so neither a null and its neighbour's value nor parts of two values can trade places."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.length(text), F.lit(":"), text)))
    return stable_hash(F.concat(*parts))


def row_hash_sql(columns: list[str]) -> str:
    """The same in DuckDB's SQL."""
    parts = [f"case when {c} is null then '-' else length(cast({c} as varchar)) || ':' || cast({c} as varchar) end" for c in columns]
    return f"cast(('0x' || substr(md5({' || '.join(parts)}), 1, 15)) as bigint)"


def fingerprint(h: Column) -> list[Column]:
    """Aggregates over a hash column: rows, sum of the high and of the low 32 bits (no overflow below 2^31 rows)."""
    return [
        F.count(h).alias(FINGERPRINT[0]),
        F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0)).alias(FINGERPRINT[1]),
        F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias(FINGERPRINT[2]),
    ]


def fingerprints(rows: DataFrame, keys: list[str], h: Column) -> DataFrame:
    """One row a partition: its keys and fingerprint. Only compact partial sums are shuffled."""
    return rows.withColumn("__h", h).groupBy(*keys).agg(*fingerprint(F.col("__h")))


def part_of(keys: list[str]) -> Column:
    """A partition's folder name: a digest of its keys that tells nulls, empty texts and case apart."""
    text = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("p"), F.md5(text))


def changed(now: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of partitions that are new or whose fingerprint differs. Null keys are keys like any other."""
    old = then.select(*[F.col(k).alias(f"__old_{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in FINGERPRINT])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__old_{k}"))
    same = F.lit(True)
    for c in FINGERPRINT:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return now.join(old, on, "left").where(~same).select(*keys)


class IncrementalTable:
    """A derived table kept up to date partition by partition. `derive` must keep the key columns.

    ``refresh(source)`` does, in this order:

    1. write the source's fingerprints and read them back, so that what is compared is what will be committed; rows
       that arrive later are the next run's;
    2. write the list of partitions to do (changed, new, or named by a run that died before its commit);
    3. recompute them and replace each by dynamic partition overwrite. Every listed partition gets a row that only
       holds its place, so one that has become empty is replaced as well;
    4. commit the fingerprints as a new version.

    A run that dies leaves its list of partitions; the next run does them again whatever their fingerprints say, even if
    the source is back in its former state. So nothing is skipped or doubled. Until that next run the listed partitions
    may show either state. Partitions that vanished from the source leave the fingerprints and so the table. Partition
    keys may be null. One run at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], columns: list[str], derive: Callable[[DataFrame], DataFrame] | None = None, hashed: Column | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.derive = derive or (lambda df: df)
        self.hash = hashed if hashed is not None else row_hash(columns)

    def version(self) -> int:
        """The last committed run, 0 before the first."""
        names = [n for n in children(self.spark, f"{self.path}/commits") if n.startswith("v") and written(self.spark, f"{self.path}/commits/{n}")]
        return max([0, *(int(n[1:]) for n in names)])

    def stored(self) -> DataFrame | None:
        """The fingerprints that the last successful run left."""
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/commits/v{v}") if v else None

    def _commit(self, prints: DataFrame, v: int) -> None:
        prints.write.mode("overwrite").parquet(f"{self.path}/commits/v{v}")

    def adopt(self, prints: DataFrame) -> None:
        """Commit fingerprints of a state whose rows need no derivation (what an earlier system has taken over)."""
        self._commit(prints.select(*self.keys, *FINGERPRINT), self.version() + 1)

    def _unfinished(self, v: int) -> list[str]:
        """Lists of partitions of runs for version v; any that is there while v isn't committed belongs to a dead run."""
        at = f"{self.path}/runs/v{v}"
        return [f"{at}/{n}/todo" for n in children(self.spark, at) if written(self.spark, f"{at}/{n}/todo")]

    def refresh(self, source: DataFrame) -> DataFrame:
        """Bring the table up to date; returns the keys of the partitions that were recomputed."""
        spark, keys, v = self.spark, self.keys, self.version() + 1
        then, dead = self.stored(), self._unfinished(v)
        run = f"{self.path}/runs/v{v}/{uuid.uuid4().hex}"
        fingerprints(source, keys, self.hash).write.parquet(f"{run}/now")
        now = spark.read.parquet(f"{run}/now")
        todo = now.select(*keys) if then is None else changed(now, then, keys)
        for path in dead:
            todo = todo.unionByName(spark.read.parquet(path).select(*keys))
        todo.distinct().withColumn(PART, part_of(keys)).write.parquet(f"{run}/todo")
        todo = spark.read.parquet(f"{run}/todo")
        parts = todo.select(PART)
        mine = join_small(source.withColumn(PART, part_of(keys)), parts, [PART], "left_semi").drop(PART)
        rows = self.derive(mine).withColumn(PART, part_of(keys)).withColumn(PLACE, F.lit(False))
        places = todo.withColumn(PLACE, F.lit(True))
        out = join_small(rows, parts, [PART], "left_semi").unionByName(places, allowMissingColumns=True)
        # a partition's rows are written by one task, those of a large one by several (by content, so that tasks can be repeated)
        lanes = max(1, -(-(now.agg(F.max(FINGERPRINT[0]).alias("n")).first()["n"] or 0) // LANE_ROWS))
        out = out.repartition(PART, F.pmod(F.xxhash64(*[F.col(f.name) for f in out.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(lanes)))
        spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{self.path}/shape")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/data")
        self._commit(now, v)
        return todo.drop(PART)

    def read(self) -> DataFrame:
        """The table as the last committed run left it."""
        shape = self.spark.read.parquet(f"{self.path}/shape")
        if not children(self.spark, f"{self.path}/data"):
            return shape.drop(PART, PLACE)
        live = self.stored().select(part_of(self.keys).alias(PART))
        data = self.spark.read.schema(shape.schema).parquet(f"{self.path}/data").where(~F.col(PLACE))
        return join_small(data, live, [PART], "left_semi").drop(PART, PLACE)


def confirmed_marks(marks: DataFrame) -> DataFrame:
    """Per follower and shard the ok report that counts: highest run, then greatest position (then latest time)."""
    ok = marks.where("status = 'ok' and last_segment is not null and last_offset is not null and follower_id is not null and shard is not null")
    best = F.max(F.struct("run_no", "last_segment", "last_offset", "confirmed_at")).alias("m")
    return ok.groupBy("follower_id", "shard").agg(best).select("follower_id", "shard", "m.last_segment", "m.last_offset", "m.confirmed_at")


RECORD_COLUMNS = ["shard", "segment", "wal_offset", "rec_len", "rec_type", "msg_id", "consumer_id", "payload", "crc_ok", "revision"]
SEGMENT = ["shard", "segment"]


def whole_records(records: DataFrame) -> DataFrame:
    """Rows that identify a record, with the hash of their content."""
    whole = records.where("shard is not null and segment is not null and wal_offset is not null")
    return whole.select("shard", "segment", "wal_offset", "revision", "written_at", row_hash(RECORD_COLUMNS).alias("content"))


def taken_over() -> Column:
    """Had the follower this row when its last successful report was confirmed? Up to the position, without repairs
    written later."""
    before = (F.col("segment") < F.col("last_segment")) | ((F.col("segment") == F.col("last_segment")) & (F.col("wal_offset") <= F.col("last_offset")))
    repaired = (F.col("revision") > 0) & (F.col("written_at") > F.col("confirmed_at"))
    return F.coalesce(before, F.lit(False)) & ~F.coalesce(repaired, F.lit(False))


def take_over_table(records: DataFrame, marks: DataFrame, path: str) -> tuple[IncrementalTable, DataFrame]:
    """(table of what each follower still has to take over, its source).

    A partition is a shard's segment. Its fingerprint sums the hashes of all (follower, record, taken over) triples; the
    one stored at the start is that of what the followers had taken over by their last successful reports. Later
    refreshes compare with what the run before has stored, so a change of content shows even without a new revision,
    and so does a follower's progress.
    """
    rows = whole_records(records)
    # the followers of a cluster are few and fixed; they come as one array from a scalar subquery
    followers = marks.where("follower_id is not null").select(F.sort_array(F.collect_set("follower_id"))).scalar()
    pairs = join_small(rows.withColumn("follower_id", F.explode(followers)), confirmed_marks(marks), ["follower_id", "shard"], "left")
    pairs = pairs.select("follower_id", "shard", "segment", "wal_offset", "content", taken_over().alias("had"))

    def derive(mine: DataFrame) -> DataFrame:
        return mine.where("not had").select("follower_id", "shard", "segment", "wal_offset").distinct()

    table = IncrementalTable(records.sparkSession, path, SEGMENT, [], derive, F.xxhash64("follower_id", "content", "had"))
    if not table.version():
        table.adopt(fingerprints(pairs.where("had"), SEGMENT, table.hash))
    return table, pairs


def records_since(records: DataFrame, marks: DataFrame, path: str | None = None) -> DataFrame:
    """Records each follower still has to take over: follower_id, shard, segment, wal_offset, once each.

    Segments whose stored fingerprint equals the present one are passed over; the others are read again, record by
    record, and replaced in the table at `path` (default: a new one in the shared folder). Rows without shard, segment
    or offset identify no record and are left out; without a report every record of the shard comes out; without any
    follower nothing does.
    """
    table, pairs = take_over_table(records, marks, path or f"{shared_dir(records.sparkSession)}/take-over-{uuid.uuid4().hex}")
    table.refresh(pairs)
    return table.read().select("follower_id", "shard", "segment", "wal_offset")
