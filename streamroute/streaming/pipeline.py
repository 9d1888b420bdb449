"""The same operators on streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from streamroute.session import children, shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table of a folder as a file stream, whether it is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path) if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, exactly once, into the shared folder, and read it back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:

        def replace(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

        w = stream.writeStream.foreachBatch(replace).outputMode(mode)
    q = w.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_batches(spark, f"{base}/out", schema, last=mode == "complete")


def read_batches(spark: SparkSession, path: str, schema, last: bool = False) -> DataFrame:
    """What a stream wrote to a folder (or to one folder a batch); with `last` only its last batch, which in complete mode
    holds the whole result. Empty where nothing was written."""
    names = children(spark, path)
    batches = sorted((n for n in names if n.startswith("batch=")), key=lambda n: int(n[6:]))
    if not names:
        return spark.createDataFrame([], schema)
    if batches:
        return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in (batches[-1:] if last else batches)])
    return spark.read.schema(schema).parquet(path)


def keep_first_available(stream: DataFrame, keys: list, order: list, names: list[str]) -> DataFrame:
    """Exactly the first arrival of each key: micro-batches in their order, rows of one batch by `order`. Every batch is
    set against the identifiers that earlier ones stored in the shared folder; a batch that is repeated gives the same
    rows. Unlike the watermark form it forgets nothing."""
    from streamroute.operators.dedup import SeenStore

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = SeenStore(spark, f"{base}/ids", keys, order, names)

    def take(df: DataFrame, batch: int) -> None:
        store.take(batch, df).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    sink_batches(stream, take, f"{base}/checkpoint").awaitTermination()
    schema = stream.withColumns(dict(zip(names, keys))).schema
    return read_batches(spark, f"{base}/out", schema)


def dedup(stream: DataFrame, key: str, at: str, keep: str = "7 days") -> DataFrame:
    """First arrival per key within the watermark; state older than `keep` is dropped. `at` is cast to timestamp."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per tumbling window and key; rows later than the watermark are dropped, windows come out once closed."""
    t = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = t.groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n")


def route_stream(events: DataFrame, subscriptions: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """A stream against a static subscription table: the masked equi-join per event (the table's shapes are few)."""
    from streamroute.operators.topics import MAX_SHAPES, _keys, shaped

    p = shaped(subscriptions, pattern)
    shapes = sorted(tuple(r) for r in p.select("__tail", "__n", "__mask").distinct().limit(MAX_SHAPES + 1).collect())
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} pattern shapes")
    on = ["__tail", "__n", "__mask", "__key"]
    keyed = events.where(F.col(topic).isNotNull()).withColumn("__k", F.explode(_keys(F.col(topic), shapes))).select("*", "__k.*").drop("__k")
    return keyed.join(p, on).drop(*on)


def fold_stream(stream: DataFrame, key: str, seq: str, columns: list[str], out: str, state: str, start: tuple, step: Callable) -> DataFrame:
    """An ordered fold per key, its state carried across micro-batches. step(state, row) gives (state, output tuple); rows
    are those of `columns` (numbers), in each micro-batch by `seq`. A key's rows of one micro-batch are sorted in one task;
    the source's limit a trigger bounds them."""
    names = ["k", "seq", *[c.split()[0] for c in out.split(", ")]]

    def update(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        pdf = pd.concat(list(parts)).sort_values("seq")[["seq", *[f"c{i}" for i in range(len(columns))]]]
        rows = []
        for n, *values in pdf.itertuples(index=False):
            now, got = step(now, [None if v is None or v != v else v for v in values])
            rows.append((k[0], n, *got))
        held.update(now)
        yield pd.DataFrame(rows, columns=names)

    slim = stream.select(F.col(key).alias("k"), F.col(seq).cast("bigint").alias("seq"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return slim.groupBy("k").applyInPandasWithState(update, f"k string, seq bigint, {out}", state, "append", GroupStateTimeout.NoTimeout)


def ema_stream(stream: DataFrame, key: str, seq: str, sample: str) -> DataFrame:
    """Integer moving average per key (folds.ema)."""

    def step(now: tuple, row: list) -> tuple:
        (x,) = row
        at = now[0] if x is None else int(x) if now[0] == 0 else (now[0] * 9 + int(x)) // 10
        return (at,), (at,)

    return fold_stream(stream, key, seq, [sample], "ema bigint", "now bigint", (0,), step)


def token_bucket_stream(stream: DataFrame, key: str, seq: str, millis: str, rate: float, burst: float) -> DataFrame:
    """Token bucket per key (folds.token_bucket)."""

    def step(now: tuple, row: list) -> tuple:
        (tokens, last), (t,) = now, row
        last = None if last < 0 else last
        if t is not None:
            if last is not None and t > last:
                tokens = min(burst, tokens + (t - last) * rate / 1000.0)
            last = t if last is None else max(last, t)
        ok = tokens >= 1.0
        return (tokens - ok, -1.0 if last is None else last), (ok,)

    return fold_stream(stream, key, seq, [millis], "allowed boolean", "tokens double, last double", (float(burst), -1.0), step)


def turns_stream(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The running number of each row within its key, from 0: whose turn it is in a group is that modulo its members."""
    return fold_stream(stream, key, seq, [], "turn bigint", "n bigint", (0,), lambda now, row: ((now[0] + 1,), (now[0],)))


def ack_timeouts(deliveries: DataFrame, acks: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Stream-stream left join: deliveries with the acknowledgement that came within the time, null where none came."""
    d = deliveries.withColumn("delivered_at", F.col("delivered_at").cast("timestamp")).withWatermark("delivered_at", late)
    a = acks.select(F.col("msg_id").alias("a_msg"), F.col("consumer_id").alias("a_consumer"), F.col("acked_at").cast("timestamp").alias("acked_at"), "status").withWatermark("acked_at", late)
    within = F.expr(f"a_msg = msg_id and a_consumer = consumer_id and acked_at >= delivered_at and acked_at <= delivered_at + interval {int(seconds)} seconds")
    return d.join(a, within, "leftOuter").drop("a_msg", "a_consumer")


def sink_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """foreachBatch sink with its own checkpoint: `write(df, batch_id)` must be idempotent per batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


PROGRESS = "batch_id bigint, rows_in bigint, rows_out bigint, state_rows bigint"


def progress(query) -> DataFrame:
    """What a query's batches read, wrote and keep as state, from its own progress reports (a sink for metrics)."""
    rows = []
    for p in query.recentProgress:
        state = sum(s["numRowsTotal"] for s in p["stateOperators"])
        rows.append((p["batchId"], p["numInputRows"], max(p["sink"]["numOutputRows"], 0), state))
    return query.sparkSession.createDataFrame(rows, PROGRESS) if hasattr(query, "sparkSession") else SparkSession.active().createDataFrame(rows, PROGRESS)
