"""Streaming twins of batch queries: files as a stream, everything available processed once, results read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute.plans import events as batch
from streamroute.session import shared_dir
from streamroute.streaming import pipeline as st


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = st.stream_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("ingest_seq"), F.col("event_id").cast("string").alias("msg_id"),
        F.concat(F.lit("event."), "event_type", F.lit(".u"), (F.col("user_id") % 10).cast("string")).alias("topic"), "event_type", "user_id", "value", "ts",
    )


def _twice(spark: SparkSession, d: str) -> DataFrame:
    again = _events(spark, d).where("ingest_seq % 10 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 100_000_000)
    return again.unionByName(_events(spark, d))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Exactly the first arrival of each id."""
    rows = _twice(spark, d).select("ingest_seq", "msg_id", "topic")
    return st.keep_first_available(rows, [F.col("msg_id")], [F.col("ingest_seq")], ["ident"]).select("ingest_seq", "msg_id", "topic")


def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    """One arrival of each id within the watermark, whichever came first in its micro-batch."""
    return st.run_available(st.dedup(_twice(spark, d), "msg_id", "ts", "60 days").select("msg_id", "topic"))


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.run_available(st.window_counts(_events(spark, d), "ts", ["event_type"], "1 hour", "1 day"))


def stream_route(spark: SparkSession, d: str) -> DataFrame:
    routed = st.route_stream(_events(spark, d).select("ingest_seq", "topic"), batch._patterns(spark))
    return st.run_available(routed.select("ingest_seq", "sub_id")).groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("micros", F.round(F.col("value") * 100).cast("bigint"))
    got = st.run_available(st.ema_stream(e, "topic", "ingest_seq", "micros"))
    return got.groupBy(F.col("k").alias("topic")).agg(F.max_by("ema", "seq").alias("last_ema"), F.max("ema").alias("most"), F.count_if(F.col("ema") < 25_000).alias("n_below"))


def stream_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("topic", "ingest_seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    got = st.run_available(st.token_bucket_stream(e, "topic", "ingest_seq", "ms", 0.001, 5))
    return got.groupBy(F.col("k").alias("topic")).agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))


def stream_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Whose turn it is among three members of each event type's group."""
    got = st.run_available(st.turns_stream(_events(spark, d), "event_type", "ingest_seq"))
    return got.select(F.col("k").alias("grp"), F.col("seq").alias("ingest_seq"), F.concat(F.lit("m"), F.col("turn") % 3).alias("member"))


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """A complete-mode aggregate: its last state."""
    n = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ingest_seq").alias("last_seq"))
    return st.run_available(n, "complete")


def stream_sink(spark: SparkSession, d: str) -> DataFrame:
    """A sink that replaces its batch's folder: run twice from the same checkpoint it holds every row once."""
    base = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    rows = _events(spark, d).select("ingest_seq", "topic")
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
    for _ in range(2):
        st.sink_batches(rows, write, f"{base}/checkpoint").awaitTermination()
    return st.read_batches(spark, f"{base}/out", rows.schema).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a query reports to have read."""
    base = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    q = _events(spark, d).select("ingest_seq").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return st.progress(q).agg(F.sum("rows_in").alias("rows_in"))


def stream_ack_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with the acknowledgement that came within 30 seconds, or false where none came in time. A delivery is given
    up once the watermark (an hour behind the last event) has passed its time."""
    sent = _events(spark, d).select("msg_id", F.lit("c").alias("consumer_id"), F.col("ts").alias("delivered_at"))
    acks = _events(spark, d).where("ingest_seq % 3 <> 0").select("msg_id", F.lit("c").alias("consumer_id"), (F.col("ts") + F.make_dt_interval(secs=(F.col("ingest_seq") % 60).cast("decimal(18,6)"))).alias("acked_at"), F.lit("done").alias("status"))
    got = st.run_available(st.ack_timeouts(sent, acks, 30))
    return got.select("msg_id", F.col("status").isNotNull().alias("acked"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_dedup_watermark, stream_window_counts, stream_route, stream_ema, stream_token_bucket, stream_round_robin, stream_totals, stream_sink, stream_progress, stream_ack_timeouts)}

SQL = {
    "stream_dedup": f"with {batch._EV} select ingest_seq, msg_id, topic from ev",
    "stream_dedup_watermark": f"with {batch._EV} select msg_id, topic from ev",
    "stream_token_bucket": batch.SQL["token_bucket"],
    "stream_round_robin": f"with {batch._EV} select event_type as grp, ingest_seq, 'm' || cast((row_number() over (partition by event_type order by ingest_seq) - 1) % 3 as varchar) as member from ev",
    "stream_totals": "select event_type, count(*) as n, max(event_id) as last_seq from events group by 1",
    "stream_progress": "select count(*) as rows_in from events",
    "stream_sink": f"with {batch._EV} select topic, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from ev group by 1",
    "stream_window_counts": """select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events
        where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) from events) - interval '1 day' group by 1, 2""",
    "stream_route": f"with {batch._EV}, {batch._subs()} select sub_id, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from ev join subs on regexp_full_match(topic, rx) group by 1",
    "stream_ema": batch.SQL["admission_ema"],
    "stream_ack_timeouts": """with w as (select least(max(ts), max(case when event_id % 3 <> 0 then ts + to_seconds(event_id % 60) end)) - interval 1 hour as t from events)
        select cast(event_id as varchar) as msg_id, event_id % 3 <> 0 and event_id % 60 <= 30 as acked from events, w where event_id % 3 <> 0 and event_id % 60 <= 30 or ts < t""",
}
