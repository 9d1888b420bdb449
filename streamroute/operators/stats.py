"""Counters and summaries of streams, logs and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topic_stats(events: DataFrame, topic: str = "topic", at: str = "produced_at", publisher: str = "service_id") -> DataFrame:
    """Messages, publishers and last time per topic."""
    return events.groupBy(topic).agg(F.count(F.lit(1)).alias("n_messages"), F.count_distinct(publisher).alias("n_publishers"), F.max(at).alias("last_at"))


def lifecycle(deliveries: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome per key."""
    s = F.col("ack_status")
    return deliveries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("delivered"), F.count_if(s.isin("done", "ok")).alias("acked"), F.count_if(s == "rejected").alias("nacked"),
        F.count_if(s == "duplicate").alias("duplicates"), F.count_if(s.isNull()).alias("in_flight"), F.count_if(F.col("attempt") > 1).alias("redelivered"),
    )


def windowed_rate(df: DataFrame, at: str, hit: Column, width: str = "5 minutes") -> DataFrame:
    """Per tumbling window: rows, hits and the share of hits."""
    w = F.window(F.col(at).cast("timestamp"), width)
    g = df.where(F.col(at).isNotNull()).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "hits", (F.col("hits") / F.col("n")).alias("share"))


def segment_stats(records: DataFrame, keys: list[str], least: float = 0.8, active: bool = True) -> DataFrame:
    """Per segment: written rows, distinct ids written and completed in it, their ratio (0 for none written) and
    whether it may be compacted. The newest segment of a shard is active and left out."""
    ids = records.where(F.col("msg_id").isNotNull()).groupBy(*keys, "msg_id").agg(
        F.count_if(F.col("rec_type") == "event_write").alias("w"), F.count_if(F.col("rec_type") == "completion").alias("c")
    )
    out = ids.groupBy(*keys).agg(F.sum("w").alias("total_events"), F.count_if((F.col("w") > 0) & (F.col("c") > 0)).alias("completed_events"))
    ratio = F.when(F.col("total_events") > 0, F.col("completed_events") / F.col("total_events")).otherwise(F.lit(0.0))
    out = out.withColumn("ratio", ratio).withColumn("eligible", F.col("ratio") >= F.lit(least))
    if active:
        newest = F.max(keys[-1]).over(Window.partitionBy(*keys[:-1])) if len(keys) > 1 else F.max(keys[-1]).over(Window.partitionBy(F.lit(1)))
        out = out.withColumn("__newest", newest).where(F.col(keys[-1]) < F.col("__newest")).drop("__newest")
    return out


def readable(records: DataFrame) -> DataFrame:
    """Log records as a replay reads them: each once (its latest revision), in every segment up to the first record
    with a failed checksum."""
    key = ["shard", "segment", "wal_offset"]
    cols = [c for c in records.columns if c not in key]
    rank = F.struct(F.coalesce("revision", F.lit(0)), F.coalesce("scan_no", F.lit(0)))
    once = records.groupBy(*key).agg(F.max_by(F.struct(*cols), rank).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in cols])
    bad = once.where(~F.coalesce(F.col("crc_ok"), F.lit(False))).groupBy("shard", "segment").agg(F.min("wal_offset").alias("__bad"))
    return once.join(bad, ["shard", "segment"], "left").where(F.col("__bad").isNull() | (F.col("wal_offset") < F.col("__bad"))).drop("__bad")


def replay_summary(records: DataFrame) -> DataFrame:
    """Per shard: distinct event ids, last segment and records of a replay."""
    ok = readable(records)
    ids = ok.where("rec_type = 'event_write'").groupBy("shard", "msg_id").agg(F.lit(1).alias("o")).groupBy("shard").agg(F.count("msg_id").alias("n_event_ids"))
    seg = records.groupBy("shard").agg(F.max("segment").alias("last_segment"))
    n = ok.groupBy("shard").agg(F.count(F.lit(1)).alias("record_count"))
    return seg.join(n, "shard", "left").join(ids, "shard", "left").fillna(0, ["record_count", "n_event_ids"])


def caught_up(marks: DataFrame, most_lag_ms: int) -> DataFrame:
    """Per shard: is every follower's latest ok report within the lag?"""
    ok = marks.where("status = 'ok'").groupBy("shard", "follower_id").agg(F.max_by("lag_ms", F.struct("run_no", "mark_id")).alias("lag_ms"))
    return ok.groupBy("shard").agg(F.count(F.lit(1)).alias("n_followers"), F.bool_and(F.coalesce(F.col("lag_ms") < most_lag_ms, F.lit(False))).alias("caught_up"))


def namespaces(events: DataFrame, ns: str = "ns", service: str = "service_id", topic: str = "topic", at: str = "arrived_at") -> DataFrame:
    """Registry: services, topics and first time per namespace."""
    return events.where(F.col(ns).isNotNull()).groupBy(ns).agg(F.count_distinct(service).alias("n_services"), F.count_distinct(topic).alias("n_topics"), F.min(at).alias("created_at"))


def topic_metadata(events: DataFrame, subscriptions: DataFrame, topic: str = "topic", at: str = "arrived_at", publisher: str = "service_id") -> DataFrame:
    """topic_stats plus the number of subscriptions (sub_id) whose pattern matches the topic."""
    from streamroute.operators.topics import match_topics

    found = match_topics(events, subscriptions, topic).groupBy(topic).agg(F.count_distinct("sub_id").alias("n_subscribers"))
    return topic_stats(events.where(F.col(topic).isNotNull()), topic, at, publisher).join(found, topic, "left").fillna(0, ["n_subscribers"])


def membership(reports: DataFrame, now: Column, suspect_s: float = 5, dead_s: float = 30) -> DataFrame:
    """State per member from its reports (member, incarnation, state, at): the highest incarnation's latest report
    counts (of equal ones the greatest state's name); 'alive' turns into 'suspect' and 'dead' when it is older than the limits."""
    last = reports.where("member is not null").groupBy("member").agg(F.max_by(F.struct("state", "at"), F.struct("incarnation", "at", "state")).alias("r"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("r.at").cast("timestamp"))
    state = F.when(F.col("r.state") == "dead", "dead").when(age > F.lit(int(dead_s * 1e6)), "dead").when((F.col("r.state") == "suspect") | (age > F.lit(int(suspect_s * 1e6))), "suspect").otherwise("alive")
    return last.select("member", state.alias("state"))


def spread_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, mean and standard deviation per key (the shape of alert rules)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"))


def sliding_rate(df: DataFrame, at: str, by: list[str], width: str = "5 minutes", slide: str = "1 minute", seconds: float = 300) -> DataFrame:
    """Events a second over sliding windows: window_end, keys, n and rate. A row counts in every window that covers it."""
    w = F.window(F.col(at).cast("timestamp"), width, slide)
    g = df.where(F.col(at).isNotNull()).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, "n", (F.col("n") / F.lit(float(seconds))).alias("rate"))


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts: keys, le (infinity last) and n, the rows whose value is at most le. Null values count
    nowhere. One row a key is shuffled, its counts side by side."""
    edges = [*bounds, float("inf")]
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*by).agg(*[F.count_if(v <= F.lit(float(b))).alias(f"__le{i}") for i, b in enumerate(edges)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"__le{i}").alias("n")) for i, b in enumerate(edges)])
    return g.select(*by, F.explode(pairs).alias("b")).select(*by, "b.le", "b.n")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float, name: str = "quantile") -> DataFrame:
    """The q-quantile of cumulative buckets, linear within the bucket that holds it (the first one begins at 0); the largest
    finite bound where it lies beyond."""
    lists = buckets.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("le", "n"))).alias("b"))
    rank = F.lit(float(q)) * F.element_at("b", -1)["n"]
    i = F.array_position(F.transform("b", lambda x: x["n"] >= F.col("rank")), True)
    at = lists.withColumn("rank", rank).withColumn("i", i.cast("int"))
    low = F.when(F.col("i") > 1, F.try_element_at("b", F.col("i") - 1)["le"]).otherwise(0.0)
    before = F.when(F.col("i") > 1, F.try_element_at("b", F.col("i") - 1)["n"]).otherwise(0)
    hit = F.try_element_at("b", F.col("i"))
    inside = low + (hit["le"] - low) * (F.col("rank") - before) / (hit["n"] - before)
    return at.select(*by, F.when(hit["le"] == float("inf"), low).otherwise(inside).alias(name))


def load_test(results: DataFrame, by: list[str], ok: Column, latency: str, at: str) -> DataFrame:
    """Per key: requests, ok and failed ones, error rate, requests a second from the first to the last, and least, mean
    and largest latency of the ok ones."""
    span = (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))) / 1e6
    lat = F.when(ok, F.col(latency))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_error"),
        (F.count_if(~F.coalesce(ok, F.lit(False))) / F.count(F.lit(1))).alias("error_rate"), F.try_divide(F.count(F.lit(1)), span).alias("per_second"),
        F.min(lat).alias("least"), F.avg(lat).alias("mean"), F.max(lat).alias("most"),
    )


def saturating_counts(ops: DataFrame, by: list[str], seq: str, delta: Column, block: int = 1 << 18) -> DataFrame:
    """What counters hold that go up and down in the order of `seq` but never below 0: keys and n.

    A run of steps is known by its sum and its lowest prefix; these states combine in order. They are made per block of
    numbers, so a key that holds most rows is spread over its blocks.
    """
    cut = ops.where(F.col(seq).isNotNull()).withColumn("__d", F.coalesce(delta.cast("bigint"), F.lit(0))).withColumn("__b", F.floor(F.col(seq) / F.lit(block)))
    run = F.sum("__d").over(Window.partitionBy(*by, "__b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    parts = cut.withColumn("__run", run).groupBy(*by, "__b").agg(F.sum("__d").alias("__sum"), F.min("__run").alias("__low"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = parts.withColumn("__low", before + F.col("__low")).groupBy(*by).agg(F.sum("__sum").alias("__sum"), F.min("__low").alias("__low"))
    return low.select(*by, (F.col("__sum") - F.least(F.lit(0), F.col("__low"))).alias("n"))


def cluster_counts(deliveries: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: deliveries in flight and dead-lettered, group members, ring nodes (rows of tables that are kept by key)."""
    n = deliveries.agg(F.count_if(F.col("state") == "in_flight").alias("in_flight"), F.count_if(F.col("state") == "dlq").alias("dead_lettered"))
    return n.select("*", members.select(F.count(F.lit(1))).scalar().alias("members"), nodes.select(F.count(F.lit(1))).scalar().alias("nodes"))


def pending_deliveries(written: DataFrame, targets: DataFrame, completed: DataFrame, key: str = "msg_id", consumer: str = "consumer_id") -> DataFrame:
    """What a recovery has to deliver again: written messages times their targets (key, consumer) without those that the
    consumer itself has completed. Null keys and consumers are no delivery."""
    wanted = targets.where(F.col(key).isNotNull() & F.col(consumer).isNotNull()).select(key, consumer).distinct()
    done = completed.where(F.col(key).isNotNull() & F.col(consumer).isNotNull()).select(key, consumer).distinct()
    return written.join(wanted, key).join(done, [key, consumer], "left_anti")


def metrics_text(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One text line a row, as scrapers read it: name{label="value",...} value. Quotes, backslashes and line ends in label
    values are escaped; null labels are left out."""
    pairs = []
    for c in labels:
        text = F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        pairs.append(F.concat(F.lit(f'{c}="'), text, F.lit('"')))
    return df.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))
