"""Queries of the stream operators over the events table (as an envelope) and the broker tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamroute.functions.msgid import canonical_id, canonical_sql
from streamroute.operators import delivery, folds, groups, numbering, ring, routing, stats, topics, transforms
from streamroute.operators.filters import StructFields, VariantFields, compile_filter
from streamroute.operators.skew import index_percentiles
from streamroute.session import join_small, table
from streamroute.sources import gateway, wal

PATTERNS = [
    ("s1", "c1", "event.click.*"), ("s2", "c1", "event.>"), ("s3", "c2", "event.*.u3"), ("s4", "c3", ">"), ("s5", "c3", "*"), ("s6", "c4", "order.f.>"), ("s7", "c5", "event.purchase.u1"),
]
ACL = [("reader", "event.view.*"), ("reader", "event.*.u1"), ("writer", "event.purchase.>"), ("nobody", "*")]
RING_NODES = ["node-a", "node-b", "node-c", "node-d", "node-e"]


def envelope(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("ingest_seq"), F.col("event_id").cast("string").alias("msg_id"),
        F.concat(F.lit("event."), "event_type", F.lit(".u"), (F.col("user_id") % 10).cast("string")).alias("topic"),
        "value", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "ts",
    )


def orders_envelope(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("ingest_seq"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("msg_id"),
        F.concat(F.lit("order."), F.lower("o_orderstatus"), F.lit("."), F.substring("o_orderpriority", 1, 1)).alias("topic"), "o_totalprice", "o_custkey",
    )


def payload_json(e: DataFrame) -> DataFrame:
    """The envelope with a JSON payload whose field k is absent, null, a text, a boolean or a number by turns."""
    turn = F.col("ingest_seq") % 5
    k = (
        F.when(turn == 0, "").when(turn == 1, ',"k":null').when(turn == 2, F.concat(F.lit(',"k":"'), F.col("k"), F.lit('"')))
        .when(turn == 3, F.when(F.col("k") % 2 == 0, ',"k":true').otherwise(',"k":false')).otherwise(F.concat(F.lit(',"k":'), F.col("k")))
    )
    body = F.concat(F.lit('{"value":'), F.col("value"), F.lit(',"user_id":'), F.col("user_id"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","nested":{"u":{"id":'), F.col("user_id") % 100, F.lit('}},"tags":["a","b"]'), k, F.lit("}"))
    return e.withColumn("body", body)


def _variant(spark: SparkSession, d: str) -> DataFrame:
    return payload_json(envelope(spark, d)).withColumn("data", F.expr("try_parse_json(body)"))


def _filters(spark: SparkSession, d: str, texts: dict[str, str]) -> DataFrame:
    fields = VariantFields("data")
    return _variant(spark, d).select("ingest_seq", *[compile_filter(t, fields, "payload").alias(n) for n, t in texts.items()])


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "sub_id string, consumer_id string, pattern string")


def _both(spark: SparkSession, d: str) -> DataFrame:
    cols = ["ingest_seq", "msg_id", "topic"]
    return envelope(spark, d).select(*cols).unionByName(orders_envelope(spark, d).select(*cols))


# topics


def topic_match_exact(spark: SparkSession, d: str) -> DataFrame:
    return topics.match_topics(_both(spark, d), _patterns(spark).where("not contains(pattern, '*') and not contains(pattern, '>')")).select("topic", "sub_id")


def topic_match_star(spark: SparkSession, d: str) -> DataFrame:
    return topics.match_topics(_both(spark, d), _patterns(spark).where("contains(pattern, '*')")).select("topic", "sub_id")


def topic_match_multi(spark: SparkSession, d: str) -> DataFrame:
    return topics.match_topics(_both(spark, d), _patterns(spark).where("contains(pattern, '>')")).select("topic", "sub_id")


def topic_match_bag(spark: SparkSession, d: str) -> DataFrame:
    got = topics.route(_both(spark, d), _patterns(spark))
    return got.groupBy("sub_id", "consumer_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("topic").alias("n_topics"))


def route_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Every published message with every subscription of the subscriptions table, counted."""
    subs = table(spark, d, "subscriptions").select("sub_id", "consumer_id", F.col("topic_pattern").alias("pattern"))
    got = topics.route(table(spark, d, "pub_messages").select("topic", "ingest_seq"), subs)
    return got.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first_seq"), F.max("ingest_seq").alias("last_seq"))


def unrouted_events(spark: SparkSession, d: str) -> DataFrame:
    subs = table(spark, d, "subscriptions").where("topic_pattern <> '>'").select(F.col("topic_pattern").alias("pattern"))
    return topics.unrouted(table(spark, d, "pub_messages").select("ingest_seq", "topic"), subs).select("ingest_seq", "topic")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    who = F.when(F.col("ingest_seq") % 3 == 0, "reader").when(F.col("ingest_seq") % 3 == 1, "writer").otherwise("nobody")
    return envelope(spark, d).select("ingest_seq", "topic", who.alias("service"))


def _acl(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACL, "service string, pattern string")


def acl_allowed(spark: SparkSession, d: str) -> DataFrame:
    return topics.permitted(_requests(spark, d), _acl(spark), ["service"]).select("ingest_seq", "service", "topic")


def acl_denied(spark: SparkSession, d: str) -> DataFrame:
    return topics.permitted(_requests(spark, d), _acl(spark), ["service"], denied=True).select("ingest_seq", "service", "topic", F.lit(4030).alias("code"))


# filters


def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"gt": "payload.value > 50", "le": "value <= 100.5", "eq": "k == 5", "ne": "k != 5", "both": "value > 50 AND k >= 3", "trailing": "value > 400 garbage"})


def filter_string(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"eq": 'event_type == "click"', "lt": 'event_type < "error"', "ne": 'k != "5"', "has": 'contains(event_type, "i")', "starts": "starts_with(event_type, 's')", "ends": 'ends_with(event_type, "w")'})


def filter_null(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"is_null": "k == null", "not_null": "k != null", "lacking": "nothing.at_all == null", "bool": "k == true", "bool_ne": "k != false"})


def filter_not(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"a": "NOT k == 5", "b": 'NOT (event_type == "click" OR value > 100)', "c": "NOT NOT value > 10", "d": 'value > 300 OR NOT k != "1" AND event_type == "view"'})


def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"numbers": "in(k, [1, 2, 3])", "texts": 'in(event_type, ["click", "view"])', "mixed": 'in(k, ["4", 4, true, null])', "floats": "in(value, [1.5])"})


def filter_len(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"text": "len(event_type, 5)", "array": "len(tags, 2)", "map": "len(nested.u, 1)", "never": "len(event_type) > 5", "other": "len(value, 3)"})


def filter_nested(spark: SparkSession, d: str) -> DataFrame:
    return _filters(spark, d, {"deep": "nested.u.id < 50", "deeper": "nested.u.id.x == null", "alias": "payload.nested.u.id >= 10 AND payload.nested.u.id < 20"})


def filter_struct(spark: SparkSession, d: str) -> DataFrame:
    """The same language over typed columns: plain comparisons that reach the scan."""
    e = table(spark, d, "events")
    keep = compile_filter('(value > 400 AND event_type == "purchase") OR user_id == 7', StructFields(e.schema))
    return e.where(keep).select("event_id", "value")


# routing and transforms

RULES = [
    routing.Rule("big", "event.purchase.>", [routing.Target("billing", where="payload.value > 40"), routing.Target("audit")], where="payload.value > 20"),
    routing.Rule("errors", "event.error.*", [routing.Target("ops", group="oncall")], where='NOT event_type == "click"'),
    routing.Rule("off", ">", [routing.Target("never")], enabled=False),
    routing.Rule("some_k", "event.*.u3", [routing.Target("lab")], where="in(k, [1, 2, 3])", transforms=[transforms.op("set", "payload.seen = true"), transforms.op("remove", "payload.tags")]),
]


def route_content_rules(spark: SparkSession, d: str) -> DataFrame:
    got = routing.apply_rules(_variant(spark, d), RULES, VariantFields("data"))
    return got.select("ingest_seq", "rule", "service", "grp")


def route_multi_target(spark: SparkSession, d: str) -> DataFrame:
    got = routing.apply_rules(_variant(spark, d), RULES[:1], VariantFields("data"))
    return got.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def route_transformed(spark: SparkSession, d: str) -> DataFrame:
    """The payload as the rule's target gets it."""
    got = routing.apply_rules(_variant(spark, d), RULES[3:], VariantFields("data"), payload_json="body")
    return got.select("ingest_seq", F.get_json_object("body", "$.seen").alias("seen"), F.get_json_object("body", "$.tags").alias("tags"), F.get_json_object("body", "$.k").alias("k"))


def deliveries_by_filter(spark: SparkSession, d: str) -> DataFrame:
    """pub_messages to the subscriptions table with its filters, the invalid one counting as none."""
    subs = [{**s, "pattern": s["topic_pattern"], "filter": s["filter_expr"]} for s in routing.collect_subscriptions(table(spark, d, "subscriptions"))]
    m = table(spark, d, "pub_messages").select("ingest_seq", "msg_id", "topic", F.expr("try_parse_json(payload)").alias("data"))
    got = routing.deliver(m, subs, VariantFields("data"))
    return got.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def _struct(spark: SparkSession, d: str) -> DataFrame:
    return envelope(spark, d).select("ingest_seq", F.struct("value", "user_id", F.when(F.col("ingest_seq") % 5 != 0, F.col("k")).alias("k"), F.struct("event_type").alias("kind")).alias("data"))


def _transform(spark: SparkSession, d: str, *ops: transforms.Op) -> DataFrame:
    e = _struct(spark, d)
    return e.select("ingest_seq", transforms.StructPayload("data", e.schema["data"].dataType).apply(list(ops)).column().alias("data"))


def transform_set(spark: SparkSession, d: str) -> DataFrame:
    return _transform(spark, d, transforms.op("set", "payload.level = 'high'"), transforms.op("set", "kind.event_type = 'x'"), transforms.op("set", "a.b = 1")).select("ingest_seq", "data.level", F.col("data.kind.event_type").alias("event_type"), F.col("data.a.b").alias("b"))


def transform_remove(spark: SparkSession, d: str) -> DataFrame:
    return _transform(spark, d, transforms.op("remove", "user_id"), transforms.op("remove", "kind.nothing")).select("ingest_seq", "data.*").drop("kind")


def transform_rename(spark: SparkSession, d: str) -> DataFrame:
    return _transform(spark, d, transforms.op("rename", "value -> amount.total")).select("ingest_seq", F.col("data.amount.total").alias("total"), "data.user_id")


def transform_copy(spark: SparkSession, d: str) -> DataFrame:
    return _transform(spark, d, transforms.op("copy", "user_id -> owner"), transforms.op("copy", "lacking -> x")).select("ingest_seq", "data.owner", "data.user_id")


def transform_default(spark: SparkSession, d: str) -> DataFrame:
    return _transform(spark, d, transforms.op("default", "k = 99"), transforms.op("default", "priority = 'normal'")).select("ingest_seq", "data.k", "data.priority")


def transform_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic payloads: a list of operations in one pass; an existing null counts as present."""
    ops = [transforms.op("default", "k = 99"), transforms.op("rename", "value -> amount.total"), transforms.op("set", "value.deep = 1"), transforms.op("copy", "nested.u.id -> uid"), transforms.op("remove", "tags")]
    out = payload_json(envelope(spark, d)).select("ingest_seq", transforms.transform_json(F.col("body"), ops).alias("body"))
    j = lambda p: F.get_json_object("body", p)
    return out.select("ingest_seq", j("$.k").alias("k"), j("$.amount.total").cast("double").alias("total"), j("$.value.deep").cast("int").alias("deep"), j("$.uid").cast("bigint").alias("uid"), j("$.tags").alias("tags"))


# deduplication and groups


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d).select("ingest_seq", "msg_id", "topic", "value")
    return e.unionByName(e.where("ingest_seq % 10 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 100_000_000))


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    from streamroute.operators.dedup import keep_first

    return keep_first(_repeated(spark, d), [F.col("msg_id")], [F.col("ingest_seq")]).select("ingest_seq", "msg_id")


def dedup_status_counts(spark: SparkSession, d: str) -> DataFrame:
    from streamroute.operators.dedup import mark_copies

    s = mark_copies(_repeated(spark, d), [F.col("msg_id")], [F.col("ingest_seq")]).withColumn("status", F.when(F.col("is_copy"), "duplicate").otherwise("stored"))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def consumer_fifo_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "deliveries").select("consumer_id", "delivery_id", canonical_id("msg_id").alias("mid"))
    return folds.last_ids(e, ["consumer_id"], ["delivery_id"], "mid").groupBy("consumer_id").agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_known"))


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = envelope(spark, d).select("ingest_seq", F.concat(F.lit("g."), "event_type").alias("grp"), F.when(F.col("ingest_seq") % 2 == 0, F.col("user_id").cast("string")).alias("pkey"))
    kinds = ["click", "view", "purchase", "error"]
    members = [(f"g.{k}", f"m{j}", i) for i, (k, j) in enumerate((k, j) for k in kinds for j in range(3 if k == "click" else 2))]
    return e, spark.createDataFrame(members, "grp string, consumer_id string, joined int")


def group_round_robin(spark: SparkSession, d: str) -> DataFrame:
    e, m = _grouped(spark, d)
    return groups.assign(e, m, "joined").select("ingest_seq", "grp", "member")


def group_partition_key(spark: SparkSession, d: str) -> DataFrame:
    e, m = _grouped(spark, d)
    return groups.assign(e, m, "joined", key=F.col("pkey")).select("ingest_seq", "grp", "member")


# delivery


def _acks(e: DataFrame) -> DataFrame:
    return e.where("ingest_seq % 3 <> 0").select(
        "msg_id", "consumer_id", F.when(F.col("ingest_seq") % 7 == 0, "rejected").otherwise("done").alias("status"),
        (F.col("delivered_at") + F.make_dt_interval(secs=(F.col("ingest_seq") % 60).cast("decimal(18,6)"))).alias("acked_at"),
    )


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d)
    return e.select("ingest_seq", "msg_id", F.concat(F.lit("c"), F.col("user_id") % 4).alias("consumer_id"), "topic", F.col("ts").alias("delivered_at"), (1 + F.col("ingest_seq") % 6).cast("int").alias("attempt"))


def ack_pending(spark: SparkSession, d: str) -> DataFrame:
    t = _tracked(spark, d)
    return delivery.pending(delivery.in_flight(t), _acks(t)).select("msg_id", "consumer_id", "attempt")


def inflight_timeouts(spark: SparkSession, d: str) -> DataFrame:
    t = _tracked(spark, d)
    return delivery.timed_out(delivery.in_flight(t), _acks(t), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 30).select("msg_id", "consumer_id")


def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    a = _tracked(spark, d).groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))
    return a.select("attempt", "n", delivery.backoff_seconds(F.col("attempt")).alias("delay_s"), delivery.sdk_retry_delay_ms(F.col("attempt")).alias("publish_delay_ms"), delivery.reconnect_delay_seconds(F.col("attempt"), tries=4).alias("reconnect_s"))


def dlq_decision(spark: SparkSession, d: str) -> DataFrame:
    a = _tracked(spark, d)
    return a.groupBy("attempt", delivery.decide(F.col("attempt"), 5).alias("by_code"), delivery.decide(F.col("attempt"), 5, "docs").alias("by_docs")).agg(F.count(F.lit(1)).alias("n"))


def _dead(spark: SparkSession, d: str) -> DataFrame:
    return delivery.dead_letters(_tracked(spark, d).withColumn("failed_at", F.col("delivered_at")))


def dlq_topics(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d).groupBy("dlq_topic").agg(F.count(F.lit(1)).alias("n"), F.max("attempts").alias("most_attempts"))


def dlq_replay(spark: SparkSession, d: str) -> DataFrame:
    return delivery.replay(_dead(spark, d), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 168)


def message_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "deliveries").select("msg_id", "consumer_id", "delivery_id", "attempt", "ack_status").withColumnRenamed("delivery_id", "delivered_at")
    return delivery.message_state(rows).groupBy("n_consumers", "finished").agg(F.count(F.lit(1)).alias("n"), F.sum("n_done").alias("n_done"), F.sum("n_dlq").alias("n_dlq"), F.sum("n_retry").alias("n_retry"))


# log and cluster


def segment_compaction_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.segment_stats(stats.readable(table(spark, d, "wal_records")), ["shard", "segment"])


def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.replay_summary(table(spark, d, "wal_records"))


def recovery_pending(spark: SparkSession, d: str) -> DataFrame:
    """Written messages times the consumers they go to (those that read the shard, and those of the deliveries) without
    what the consumer itself completed."""
    r = stats.readable(table(spark, d, "wal_records")).withColumn("msg_id", canonical_id("msg_id"))
    written = r.where("rec_type = 'event_write' and msg_id is not null").select("shard", "msg_id").distinct()
    done = r.where("rec_type = 'completion'").select("shard", "msg_id", "consumer_id")
    readers = join_small(written, done.where("consumer_id is not null").select("shard", "consumer_id").distinct(), ["shard"])
    targets = table(spark, d, "deliveries").select(canonical_id("msg_id").alias("msg_id"), "consumer_id").unionByName(readers.select("msg_id", "consumer_id"))
    left = stats.pending_deliveries(written, targets, done)
    return left.groupBy("shard", "consumer_id").agg(F.count(F.lit(1)).alias("n_pending"), F.count_distinct("msg_id").alias("n_messages"))


def wal_shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return wal.with_shard(table(spark, d, "pub_messages").select("topic"), 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("topic").alias("n_topics"))


def ring_owner(spark: SparkSession, d: str) -> DataFrame:
    t = envelope(spark, d).select("topic").distinct()
    return ring.place(t, ring.HashRing(RING_NODES)).select("topic", F.get("owners", F.lit(0)).alias("owner"))


def ring_replicas(spark: SparkSession, d: str) -> DataFrame:
    t = envelope(spark, d).select("topic").distinct()
    return ring.place(t, ring.HashRing(RING_NODES), 2).select("topic", F.array_join("owners", ",").alias("owners"))


def replication_caught_up(spark: SparkSession, d: str) -> DataFrame:
    return stats.caught_up(table(spark, d, "replica_marks"), 500)


def namespace_registry(spark: SparkSession, d: str) -> DataFrame:
    return stats.namespaces(table(spark, d, "pub_messages"))


# flow, statistics


def admission_ema(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d).select("topic", "ingest_seq", F.round(F.col("value") * 100).cast("bigint").alias("micros"))
    return folds.ema(e, ["topic"], ["ingest_seq"], "micros").groupBy("topic").agg(F.max_by("ema", "ingest_seq").alias("last_ema"), F.max("ema").alias("most"), F.count_if(F.col("ema") < 25_000).alias("n_below"))


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d).select("topic", "ingest_seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return folds.token_bucket(e, ["topic"], ["ingest_seq"], "ms", 0.001, 5).groupBy("topic").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))


def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.topic_stats(table(spark, d, "pub_messages"), at="arrived_at")


def lifecycle_counters(spark: SparkSession, d: str) -> DataFrame:
    return stats.lifecycle(table(spark, d, "deliveries"), ["consumer_id"])


def latency_percentiles_by_topic(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d).select("topic", F.round(F.col("value") * 100).cast("bigint").alias("micros"))
    return index_percentiles(e, ["topic"], "micros", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def dlq_rate_5m(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d).select("ts", (F.col("ingest_seq") % 6 >= 4).alias("dead"))
    return stats.windowed_rate(e, "ts", F.col("dead"))


def ring_buffer_last_n(spark: SparkSession, d: str) -> DataFrame:
    return numbering.last_n(table(spark, d, "pub_messages").select("topic", "ingest_seq"), 3, "ingest_seq", ["topic"])


def request_reply_join(spark: SparkSession, d: str) -> DataFrame:
    e = envelope(spark, d)
    asked = e.where("event_type = 'click'").select("msg_id", F.concat(F.lit("inbox.u"), "user_id").alias("reply_to"), F.lit("rpc").alias("topic"), F.col("ts").alias("at"))
    answered = e.where("event_type = 'view'").select("msg_id", F.concat(F.lit("inbox.u"), "user_id").alias("topic"), F.col("ts").alias("at"))
    return routing.request_replies(asked, answered, 3600).select("msg_id", "reply_id")


def position_replay(spark: SparkSession, d: str) -> DataFrame:
    """Subscriptions at 'latest' get only what came after they began; the others everything."""
    m = table(spark, d, "pub_messages").select("ingest_seq", "msg_id", "topic")
    half = m.agg(F.max("ingest_seq").alias("m")).first()["m"] or 0
    subs = [{**s, "pattern": s["topic_pattern"], "position": s["start_at"], "since": half // 2} for s in routing.collect_subscriptions(table(spark, d, "subscriptions"))]
    got = routing.deliver(m, subs, StructFields(T.StructType([])), seq="ingest_seq")
    return got.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first_seq"))


def batch_atomicity(spark: SparkSession, d: str) -> DataFrame:
    """Batches of pub_messages all of whose rows have an id and a topic."""
    ok = F.col("msg_id").isNotNull() & F.coalesce(F.col("topic") != "", F.lit(False))
    return table(spark, d, "pub_messages").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("whole"))


def gateway_publishes(spark: SparkSession, d: str) -> DataFrame:
    got = gateway.publishes(table(spark, d, "raw_requests"))
    return got.groupBy("status", F.coalesce("topic", F.lit("")).alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("headers")).alias("n_headers"))


def consumers_once(spark: SparkSession, d: str) -> DataFrame:
    """One copy a consumer instead of one a subscription."""
    subs = [{**s, "pattern": s["topic_pattern"]} for s in routing.collect_subscriptions(table(spark, d, "subscriptions"))]
    got = routing.deliver(table(spark, d, "pub_messages").select("ingest_seq", "msg_id", "topic"), subs, StructFields(T.StructType([])), once_per_consumer=True)
    return got.groupBy("consumer_id").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicate, match, filter by content and count per consumer."""
    from streamroute.operators.dedup import keep_first

    e = envelope(spark, d)
    again = e.unionByName(e.where("ingest_seq % 10 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 100_000_000))
    first = keep_first(again, [F.col("msg_id")], [F.col("ingest_seq")])
    kept = first.where(compile_filter("payload.value > 50", StructFields(e.schema), "payload"))
    got = join_small(kept, topics.match_topics(kept, _patterns(spark)), ["topic"])
    return got.groupBy("consumer_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def message_running_number(spark: SparkSession, d: str) -> DataFrame:
    """Position of each message within its topic, by arrival."""
    return numbering.number_rows(table(spark, d, "pub_messages").select("ingest_seq", "topic"), ["topic"], "ingest_seq", "rn", 4096)


def topic_metadata(spark: SparkSession, d: str) -> DataFrame:
    subs = table(spark, d, "subscriptions").select("sub_id", F.col("topic_pattern").alias("pattern"))
    return stats.topic_metadata(table(spark, d, "pub_messages"), subs)


def most_specific_match(spark: SparkSession, d: str) -> DataFrame:
    """One subscription per event topic: the most specific pattern."""
    got = topics.match_topics(_both(spark, d), _patterns(spark))
    return topics.most_specific(got, ["topic"]).select("topic", "pattern", "sub_id")


def cluster_membership(spark: SparkSession, d: str) -> DataFrame:
    """Followers as members, their marks as reports, a second after the last one of all."""
    state = F.when(F.col("status") == "failed", "suspect").when(F.col("status") == "timeout", "dead").otherwise("alive")
    r = table(spark, d, "replica_marks").where("confirmed_at is not null").select(F.col("follower_id").alias("member"), (F.col("run_no") % 3).alias("incarnation"), state.alias("state"), F.col("confirmed_at").alias("at"))
    now = r.select(F.max("at") + F.expr("interval 1 second")).scalar()
    return stats.membership(r, now, 3600, 86_400)


def value_spread(spark: SparkSession, d: str) -> DataFrame:
    return stats.spread_by(envelope(spark, d).select("event_type", F.round("value").alias("v")), ["event_type"], "v").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, topic_match_exact, topic_match_star, topic_match_multi, topic_match_bag, route_subscriptions, unrouted_events, acl_allowed, acl_denied, filter_compare, filter_string,
        filter_null, filter_not, filter_in, filter_len, filter_nested, filter_struct, route_content_rules, route_multi_target, route_transformed, deliveries_by_filter, transform_set,
        transform_remove, transform_rename, transform_copy, transform_default, transform_pipeline, dedup_first_wins, dedup_status_counts, consumer_fifo_dedup, group_round_robin,
        group_partition_key, ack_pending, inflight_timeouts, backoff_schedule, dlq_decision, dlq_topics, dlq_replay, message_states, segment_compaction_stats, replay_summary,
        recovery_pending, wal_shard_counts, ring_owner, ring_replicas, replication_caught_up, namespace_registry, admission_ema, token_bucket, topic_stats, lifecycle_counters,
        latency_percentiles_by_topic, dlq_rate_5m, ring_buffer_last_n, request_reply_join, position_replay, batch_atomicity, gateway_publishes, consumers_once, message_running_number,
        topic_metadata, most_specific_match, cluster_membership, value_spread,
    )
}


from streamroute.plans.broker import _BODIES  # noqa: E402

# SQL --------------------------------------------------------------------------------------------------------------

_EV = """ev as (select event_id as ingest_seq, cast(event_id as varchar) as msg_id, 'event.' || event_type || '.u' || cast(user_id % 10 as varchar) as topic,
  value, user_id, event_type, cast(json_extract(props, '$.k') as int) as k, ts, event_id % 5 as turn from events)"""
_OR = """ord as (select o_orderkey as ingest_seq, 'order.' || lower(o_orderstatus) || '.' || substr(o_orderpriority, 1, 1) as topic from orders)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


def _subs() -> str:
    rows = [(s, c, p, topics.pattern_regex(p)) for s, c, p in PATTERNS]
    return f"subs(sub_id, consumer_id, pattern, rx) as (values {_values(rows)})"


#: Regular expression of a pattern column, in SQL (segments quoted where they aren't wildcards).
_RX = r"""'(?s)\A' || case when {0} = '>' then '.*' else replace(replace(regexp_replace(regexp_escape({0}), '\\>.*$', chr(1)), '\*', '[^.]*'), chr(1), '.+') end || '\z'"""

_TM = f"with {_EV}, {_OR}, {_subs()}, t as (select topic from ev union select topic from ord) select topic, sub_id from t join subs on regexp_full_match(topic, rx)"
_PUB_SUB = f"s as (select *, {_RX.format('topic_pattern')} as rx from subscriptions where topic_pattern is not null)"
_TR = "d as (select ingest_seq, msg_id, 'c' || cast(user_id % 4 as varchar) as consumer_id, topic, ts as delivered_at, cast(1 + ingest_seq % 6 as int) as attempt from ev)"
_ACK = "a as (select msg_id, consumer_id, case when ingest_seq % 7 = 0 then 'rejected' else 'done' end as status, delivered_at + to_seconds(ingest_seq % 60) as acked_at from d where ingest_seq % 3 <> 0)"
_REQ = f"with {_EV}, acl(service, rx) as (values {_values([(s, topics.pattern_regex(p)) for s, p in ACL])}), r as (select ingest_seq, topic, case ingest_seq % 3 when 0 then 'reader' when 1 then 'writer' else 'nobody' end as service from ev)"
_READ = """once as (select * from (select *, row_number() over (partition by shard, segment, wal_offset order by coalesce(revision, 0) desc, coalesce(scan_no, 0) desc) rn from wal_records) where rn = 1),
  bad as (select shard, segment, min(wal_offset) b from once where not coalesce(crc_ok, false) group by 1, 2),
  ok as (select o.* from once o left join bad using (shard, segment) where b is null or wal_offset < b)"""
_H = "cast(('0x' || substr(md5({0}), 1, 15)) as bigint)"
_DUP = f"with {_EV}, u as (select ingest_seq, msg_id from ev union all select ingest_seq + 100000000, msg_id from ev where ingest_seq % 10 = 0), r as (select *, row_number() over (partition by msg_id order by ingest_seq) rn from u)"
_GRP = """g as (select ingest_seq, 'g.' || event_type as grp, case when ingest_seq % 2 = 0 then cast(user_id as varchar) end as pkey from ev),
  n as (select grp, case grp when 'g.click' then 3 when 'g.signup' then 0 else 2 end as n from (select distinct grp from g))"""
_NUM = "turn = 4"  # k is a number


def _ring_sql(replicas: int, column: str) -> str:
    pts = ", ".join(f"({p}, '{','.join(names)}')" for p, names in ring.HashRing(RING_NODES).owners(replicas))
    first = ",".join(ring.HashRing(RING_NODES).owners(replicas)[0][1])
    return f"with {_EV}, r(p, names) as (values {pts}), t as (select distinct topic, {_H.format('topic')} as h from ev) select topic, coalesce((select arg_min(names, p) from r where p >= h), '{first}') as {column} from t"


SQL = {
    "flagship": f"""with {_EV}, {_subs()} select consumer_id, count(*) as n, count(distinct user_id) as n_users, cast(sum(cast(value as decimal(18,2))) as double) as total
        from ev join subs on regexp_full_match(topic, rx) where value > 50 group by 1""",
    "topic_match_exact": _TM + " where not contains(pattern, '*') and not contains(pattern, '>')",
    "topic_match_star": _TM + " where contains(pattern, '*')",
    "topic_match_multi": _TM + " where contains(pattern, '>')",
    "topic_match_bag": f"with {_EV}, {_OR}, {_subs()}, t as (select topic from ev union all select topic from ord) select sub_id, consumer_id, count(*) as n, count(distinct topic) as n_topics from t join subs on regexp_full_match(topic, rx) group by 1, 2",
    "route_subscriptions": f"with {_PUB_SUB} select sub_id, count(*) as n, min(ingest_seq) as first_seq, max(ingest_seq) as last_seq from pub_messages m join s on regexp_full_match(m.topic, s.rx) group by 1",
    "unrouted_events": f"with {_PUB_SUB} select ingest_seq, topic from pub_messages m where topic is null or not exists (select 1 from s where topic_pattern <> '>' and regexp_full_match(m.topic, s.rx))",
    "acl_allowed": _REQ + " select ingest_seq, service, topic from r where exists (select 1 from acl where acl.service = r.service and regexp_full_match(topic, rx))",
    "acl_denied": _REQ + " select ingest_seq, service, topic, 4030 as code from r where not exists (select 1 from acl where acl.service = r.service and regexp_full_match(topic, rx))",
    "filter_compare": f"""with {_EV} select ingest_seq, value > 50 as gt, value <= 100.5 as le, ({_NUM} and k = 5) as eq, (turn = 0 or {_NUM} and k <> 5) as ne,
        (value > 50 and {_NUM} and k >= 3) as both, value > 400 as trailing from ev""",
    "filter_string": f"""with {_EV} select ingest_seq, event_type = 'click' as eq, event_type < 'error' as lt, (turn = 0 or turn = 2 and k <> 5) as ne, contains(event_type, 'i') as has,
        starts_with(event_type, 's') as starts, suffix(event_type, 'w') as ends from ev""",
    "filter_null": f"""with {_EV} select ingest_seq, turn <= 1 as is_null, turn > 1 as not_null, true as lacking, (turn = 3 and k % 2 = 0) as bool, (turn = 0 or turn = 3 and k % 2 = 0) as bool_ne from ev""",
    "filter_not": f"""with {_EV} select ingest_seq, not ({_NUM} and k = 5) as a, not (event_type = 'click' or value > 100) as b, value > 10 as c,
        (value > 300 or (not (turn = 0 or turn = 2 and k <> 1) and event_type = 'view')) as d from ev""",
    "filter_in": f"""with {_EV} select ingest_seq, ({_NUM} and k in (1, 2, 3)) as numbers, event_type in ('click', 'view') as texts, (turn in (2, 4) and k = 4) as mixed, false as floats from ev""",
    "filter_len": f"with {_EV} select ingest_seq, octet_length(encode(event_type)) = 5 as text, true as \"array\", true as \"map\", false as never, false as other from ev",
    "filter_nested": f"with {_EV} select ingest_seq, user_id % 100 < 50 as deep, true as deeper, user_id % 100 between 10 and 19 as alias from ev",
    "filter_struct": "select event_id, value from events where (value > 400 and event_type = 'purchase') or user_id = 7",
    "route_content_rules": f"""with {_EV} select ingest_seq, 'big' as rule, 'billing' as service, cast(null as varchar) as grp from ev where event_type = 'purchase' and value > 40
        union all select ingest_seq, 'big', 'audit', null from ev where event_type = 'purchase' and value > 20
        union all select ingest_seq, 'errors', 'ops', 'oncall' from ev where event_type = 'error'
        union all select ingest_seq, 'some_k', 'lab', null from ev where user_id % 10 = 3 and {_NUM} and k in (1, 2, 3)""",
    "route_multi_target": f"""with {_EV} select 'billing' as service, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from ev where event_type = 'purchase' and value > 40
        union all select 'audit', count(*), cast(sum(ingest_seq) as bigint) from ev where event_type = 'purchase' and value > 20""",
    "route_transformed": f"with {_EV} select ingest_seq, 'true' as seen, cast(null as varchar) as tags, cast(k as varchar) as k from ev where user_id % 10 = 3 and {_NUM} and k in (1, 2, 3)",
    "deliveries_by_filter": f"""with {_PUB_SUB}, j as (select *, case when json_valid(payload) then cast(payload as json) end as js from pub_messages),
        x as (select s.sub_id, s.filter_expr f, ingest_seq, js, json_type(js, '$.n') tn, json_type(js, '$.v') tv, json_type(js, '$.total') tt, json_type(js, '$.method') tm from j join s on regexp_full_match(j.topic, s.rx))
        select sub_id, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from x where case
          when f = 'payload.total > 50' then coalesce(tt in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(js->>'$.total' as double) > 50, false)
          when f = 'NOT method == "voucher"' then not coalesce(tm = 'VARCHAR' and js->>'$.method' = 'voucher', false)
          when f = 'payload.v != null' then coalesce(tv <> 'NULL', false)
          when f = 'payload.v > 0.5' then coalesce(tv in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(js->>'$.v' as double) > 0.5, false)
          when f = 'payload.n > 3' then coalesce(tn in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(js->>'$.n' as double) > 3, false)
          when f = 'payload.n > 0' then coalesce(tn in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(js->>'$.n' as double) > 0, false)
          else true end group by 1""",
    "transform_set": f"with {_EV} select ingest_seq, 'high' as level, 'x' as event_type, 1 as b from ev",
    "transform_remove": f"with {_EV} select ingest_seq, value, case when turn <> 0 then k end as k from ev",
    "transform_rename": f"with {_EV} select ingest_seq, value as total, user_id from ev",
    "transform_copy": f"with {_EV} select ingest_seq, user_id as owner, user_id from ev",
    "transform_default": f"with {_EV} select ingest_seq, case when turn = 0 then 99 else k end as k, 'normal' as priority from ev",
    "transform_pipeline": f"""with {_EV} select ingest_seq, case turn when 0 then '99' when 1 then null when 3 then case when k % 2 = 0 then 'true' else 'false' end else cast(k as varchar) end as k,
        value as total, 1 as deep, user_id % 100 as uid, cast(null as varchar) as tags from ev""",
    "dedup_first_wins": _DUP + " select ingest_seq, msg_id from r where rn = 1",
    "dedup_status_counts": _DUP + " select case when rn = 1 then 'stored' else 'duplicate' end as status, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from r group by 1",
    # the filter's 10,000 ids hold all of a consumer's at the scale at which this is compared
    "consumer_fifo_dedup": f"""with n as (select consumer_id, case when mid is null then 1 else row_number() over (partition by consumer_id, mid order by delivery_id) end rn
        from (select consumer_id, delivery_id, {canonical_sql("msg_id")} as mid from deliveries))
        select consumer_id, count(*) filter (where rn = 1) as n_new, count(*) filter (where rn > 1) as n_known from n group by 1""",
    "group_round_robin": f"""with {_EV}, {_GRP}, q as (select *, row_number() over (partition by grp order by ingest_seq) rn from g)
        select ingest_seq, grp, case when n > 0 then 'm' || cast((rn - 1) % n as varchar) end as member from q join n using (grp)""",
    "group_partition_key": f"""with {_EV}, {_GRP}, q as (select *, row_number() over (partition by grp, pkey is null order by ingest_seq) rn from g)
        select ingest_seq, grp, case when n > 0 then 'm' || cast(case when pkey is null then (rn - 1) % n else {_H.format('pkey')} % n end as varchar) end as member from q join n using (grp)""",
    "ack_pending": f"with {_EV}, {_TR}, {_ACK} select msg_id, consumer_id, attempt from d where not exists (select 1 from a where a.msg_id = d.msg_id and a.consumer_id = d.consumer_id and status <> 'rejected')",
    "inflight_timeouts": f"""with {_EV}, {_TR}, {_ACK} select msg_id, consumer_id from d where delivered_at < timestamp '2024-01-10 00:00:00' - interval 30 seconds
        and not exists (select 1 from a where a.msg_id = d.msg_id and a.consumer_id = d.consumer_id and status <> 'rejected' and acked_at <= timestamp '2024-01-10 00:00:00')""",
    "backoff_schedule": f"with {_EV}, {_TR} select attempt, count(*) as n, cast(least(pow(2, greatest(attempt - 1, 0)), 60) as double) as delay_s, cast(100 * pow(2, attempt) as double) as publish_delay_ms, case when attempt <= 4 then cast(least(pow(2, greatest(attempt - 1, 0)), 30) as double) end as reconnect_s from d group by attempt",
    "dlq_decision": f"with {_EV}, {_TR} select attempt, case when attempt + 1 >= 5 then 'dlq' else 'retry' end as by_code, case when attempt >= 5 then 'dlq' else 'retry' end as by_docs, count(*) as n from d group by 1, 2, 3",
    "dlq_topics": f"with {_EV}, {_TR} select 'dlq.' || topic as dlq_topic, count(*) as n, max(attempt) as most_attempts from d where attempt + 1 >= 5 group by 1",
    "dlq_replay": f"with {_EV}, {_TR} select msg_id, consumer_id, topic, 1 as attempt from d where attempt + 1 >= 5 and delivered_at >= timestamp '2024-01-25 00:00:00' - interval 168 hours",
    "message_states": """with l as (select *, row_number() over (partition by msg_id, consumer_id order by delivery_id desc) rn from deliveries where msg_id is not null and consumer_id is not null),
        s as (select msg_id, case when ack_status in ('done', 'ok', 'duplicate') then 'done' when ack_status = 'rejected' and coalesce(attempt, 1) + 1 >= 5 then 'dlq' when ack_status = 'rejected' then 'retry' else 'delivered' end as state from l where rn = 1),
        m as (select msg_id, count(*) as n_consumers, count(*) filter (where state = 'done') d, count(*) filter (where state = 'dlq') q, count(*) filter (where state = 'retry') r, bool_and(state in ('done', 'dlq')) as finished from s group by 1)
        select n_consumers, finished, count(*) as n, cast(sum(d) as bigint) as n_done, cast(sum(q) as bigint) as n_dlq, cast(sum(r) as bigint) as n_retry from m group by 1, 2""",
    "segment_compaction_stats": f"""with {_READ}, i as (select shard, segment, msg_id, count(*) filter (where rec_type = 'event_write') w, count(*) filter (where rec_type = 'completion') c from ok where msg_id is not null group by 1, 2, 3),
        g as (select shard, segment, cast(sum(w) as bigint) as total_events, count(*) filter (where w > 0 and c > 0) as completed_events from i group by 1, 2)
        select *, case when total_events > 0 then completed_events / total_events else 0.0 end as ratio, case when total_events > 0 then completed_events / total_events else 0.0 end >= 0.8 as eligible
        from g where segment < (select max(segment) from g h where h.shard = g.shard)""",
    "replay_summary": f"""with {_READ} select w.shard, max(w.segment) as last_segment, (select count(*) from ok where ok.shard = w.shard) as record_count,
        (select count(distinct msg_id) from ok where ok.shard = w.shard and rec_type = 'event_write') as n_event_ids from wal_records w group by 1""",
    "recovery_pending": f"""with {_READ}, o as (select shard, rec_type, consumer_id, {canonical_sql("msg_id")} as mid from ok),
        w as (select distinct shard, mid from o where rec_type = 'event_write' and mid is not null),
        t as (select {canonical_sql("msg_id")} as mid, consumer_id from deliveries where consumer_id is not null union
          select w.mid, c.consumer_id from w join (select distinct shard, consumer_id from o where rec_type = 'completion' and consumer_id is not null) c using (shard))
        select shard, t.consumer_id, count(*) as n_pending, count(distinct w.mid) as n_messages from w join t using (mid)
        where not exists (select 1 from o where o.rec_type = 'completion' and o.mid = w.mid and o.consumer_id = t.consumer_id) group by 1, 2""",
    "wal_shard_counts": f"select cast(coalesce({_H.format('topic')} % 8, 0) as int) as shard, count(*) as n, count(distinct topic) as n_topics from pub_messages group by 1",
    "ring_owner": _ring_sql(0, "owner"),
    "ring_replicas": _ring_sql(2, "owners"),
    "replication_caught_up": """with l as (select *, row_number() over (partition by shard, follower_id order by run_no desc, mark_id desc) rn from replica_marks where status = 'ok')
        select shard, count(*) as n_followers, bool_and(coalesce(lag_ms < 500, false)) as caught_up from l where rn = 1 group by 1""",
    "namespace_registry": "select ns, count(distinct service_id) as n_services, count(distinct topic) as n_topics, min(arrived_at) as created_at from pub_messages where ns is not null group by 1",
    "admission_ema": f"""with recursive {_EV}, n as (select topic, ingest_seq, cast(round(value * 100) as bigint) as x, row_number() over (partition by topic order by ingest_seq) rn from ev),
        f as (select topic, ingest_seq, rn, x as ema from n where rn = 1 union all select n.topic, n.ingest_seq, n.rn, case when f.ema = 0 then n.x else (f.ema * 9 + n.x) // 10 end from f join n on n.topic = f.topic and n.rn = f.rn + 1)
        select topic, arg_max(ema, ingest_seq) as last_ema, max(ema) as most, count(*) filter (where ema < 25000) as n_below from f group by 1""",
    "token_bucket": f"""with recursive {_EV}, n as (select topic, epoch_ms(ts) as ms, row_number() over (partition by topic order by ingest_seq) rn from ev),
        f as (select topic, rn, ms as last, 4.0::double as tokens, true as ok from n where rn = 1
          union all select n.topic, n.rn, greatest(f.last, n.ms), least(5.0::double, f.tokens + greatest(n.ms - f.last, 0)::double * 0.001::double / 1000.0::double) - case when least(5.0::double, f.tokens + greatest(n.ms - f.last, 0)::double * 0.001::double / 1000.0::double) >= 1 then 1.0::double else 0.0::double end, least(5.0::double, f.tokens + greatest(n.ms - f.last, 0)::double * 0.001::double / 1000.0::double) >= 1
          from f join n on n.topic = f.topic and n.rn = f.rn + 1)
        select topic, count(*) filter (where ok) as n_allowed, count(*) filter (where not ok) as n_refused from f group by 1""",
    "topic_stats": "select topic, count(*) as n_messages, count(distinct service_id) as n_publishers, max(arrived_at) as last_at from pub_messages group by 1",
    "lifecycle_counters": """select consumer_id, count(*) as delivered, count(*) filter (where ack_status in ('done', 'ok')) as acked, count(*) filter (where ack_status = 'rejected') as nacked,
        count(*) filter (where ack_status = 'duplicate') as duplicates, count(*) filter (where ack_status is null) as in_flight, count(*) filter (where attempt > 1) as redelivered from deliveries group by 1""",
    "latency_percentiles_by_topic": f"""with {_EV}, l as (select topic, list_sort(list(cast(round(value * 100) as bigint))) as v from ev group by 1)
        select topic, v[cast(floor(len(v) * 0.5) as int) + 1] as p50, v[cast(floor(len(v) * 0.95) as int) + 1] as p95, v[cast(floor(len(v) * 0.99) as int) + 1] as p99 from l""",
    "dlq_rate_5m": f"""with {_EV} select time_bucket(interval '5 minutes', ts) as window_start, count(*) as n, count(*) filter (where ingest_seq % 6 >= 4) as hits,
        count(*) filter (where ingest_seq % 6 >= 4) / count(*) as share from ev group by 1""",
    "ring_buffer_last_n": "select topic, ingest_seq from (select topic, ingest_seq, row_number() over (partition by topic order by ingest_seq desc) rn from pub_messages) where rn <= 3",
    "request_reply_join": f"with {_EV} select q.msg_id, p.msg_id as reply_id from ev q join ev p on p.user_id = q.user_id and p.ts >= q.ts and p.ts <= q.ts + interval 1 hour where q.event_type = 'click' and p.event_type = 'view'",
    "position_replay": f"""with {_PUB_SUB} select sub_id, count(*) as n, min(ingest_seq) as first_seq from pub_messages m join s on regexp_full_match(m.topic, s.rx)
        where coalesce(start_at, '') <> 'latest' or ingest_seq > (select max(ingest_seq) // 2 from pub_messages) group by 1""",
    "batch_atomicity": "select batch_no, count(*) as n, bool_and(msg_id is not null and coalesce(topic <> '', false)) as whole from pub_messages group by 1",
    "gateway_publishes": f"""with {_BODIES}, e as (select *, case when json_type(js, '$.topic') = 'VARCHAR' then js->>'$.topic' end as topic,
          case when json_type(js, '$.headers') = 'OBJECT' then len(json_keys(js, '$.headers')) else 0 end as h from ev where json_type(js) = 'OBJECT'),
        u as (select case when coalesce(topic, '') <> '' then 'stored' else 'error 4000' end as status, coalesce(topic, '') as topic, h from e
          union all select 'error 4000', '', 0 from raw_requests where body is null or not json_valid(body) or json_type(body) <> 'OBJECT' or regexp_matches(body, '(NaN|Infinity)'))
        select status, topic, count(*) as n, cast(sum(h) as bigint) as n_headers from u group by 1, 2""",
    "consumers_once": f"with {_PUB_SUB} select consumer_id, count(distinct ingest_seq) as n from pub_messages m join s on regexp_full_match(m.topic, s.rx) group by 1",
    "message_running_number": "select ingest_seq, topic, row_number() over (partition by topic order by ingest_seq) as rn from pub_messages",
    "topic_metadata": f"""with {_PUB_SUB} select topic, count(*) as n_messages, count(distinct service_id) as n_publishers, max(arrived_at) as last_at,
        (select count(distinct sub_id) from s where regexp_full_match(m.topic, s.rx)) as n_subscribers from pub_messages m where topic is not null group by topic""",
    "most_specific_match": f"""with {_EV}, {_OR}, {_subs()}, t as (select topic from ev union select topic from ord),
        r as (select topic, pattern, sub_id, row_number() over (partition by topic order by contains(pattern, '>'), len(pattern) - len(replace(pattern, '*', '')), len(pattern) desc, pattern) rn from t join subs on regexp_full_match(topic, rx))
        select topic, pattern, sub_id from r where rn = 1""",
    "cluster_membership": """with r as (select follower_id as member, run_no % 3 as incarnation, case status when 'failed' then 'suspect' when 'timeout' then 'dead' else 'alive' end as state, confirmed_at
          from replica_marks where confirmed_at is not null and follower_id is not null),
        l as (select *, row_number() over (partition by member order by incarnation desc nulls last, confirmed_at desc, state desc) rn from r),
        n as (select max(confirmed_at) + interval 1 second as t from replica_marks)
        select member, case when state = 'dead' or epoch_us(t) - epoch_us(confirmed_at) > 86400000000 then 'dead' when state = 'suspect' or epoch_us(t) - epoch_us(confirmed_at) > 3600000000 then 'suspect' else 'alive' end as state
        from l, n where rn = 1""",
    "value_spread": f"with {_EV} select event_type, count(*) as n, round(avg(round(value)), 6) as mean, round(stddev_samp(round(value)), 6) as stddev from ev group by 1",
}
