"""Queries of deduplication tiers, flow control, retries, logs, control tables and counters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute import broker
from streamroute.functions.msgid import canonical_id, canonical_sql
from streamroute.operators import access, dedup, delivery, folds, groups, numbering, ring, routing, stats, topics
from streamroute.operators.filters import FilterError, VariantFields, compile_filter
from streamroute.plans import events as ev
from streamroute.session import materialize, shared_dir, table
from streamroute.sources import config, wal

# deduplication tiers


def dedup_tiered_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stored and duplicate rows in each mode of the tiers."""
    out = None
    for mode in dedup.MODES:
        got = dedup.tiered(ev._repeated(spark, d), F.col("msg_id"), "ingest_seq", mode)
        n = got.groupBy(F.lit(mode).alias("mode"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))
        out = n if out is None else out.unionByName(n)
    return out


def batch_hole(spark: SparkSession, d: str) -> DataFrame:
    """What a pipeline stores that checks a whole batch before it inserts any of it."""
    got = dedup.checks_before_inserts(table(spark, d, "pub_messages"), canonical_id("msg_id"), "batch_no")
    return got.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def consumer_handler_order(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries a consumer's handler sees when ids are kept before it runs, and when only after it succeeded."""
    e = table(spark, d, "deliveries").select("consumer_id", "delivery_id", canonical_id("msg_id").alias("mid"), F.coalesce(F.col("ack_status").isin("done", "ok"), F.lit(False)).alias("ok"))
    before = folds.last_ids(e, ["consumer_id"], ["delivery_id"], "mid", name="before")
    both = folds.last_ids(before, ["consumer_id"], ["delivery_id"], "mid", name="after", handled="ok")
    return both.groupBy("consumer_id").agg(F.count_if("before").alias("n_before"), F.count_if("after").alias("n_after"))


# flow control and retries


def admission_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = ev.envelope(spark, d).select("topic", "ingest_seq", F.round(F.col("value") * 100).cast("bigint").alias("micros"))
    latched = folds.admitted(e, ["topic"], ["ingest_seq"], "micros", 9_000, name="latched")
    both = folds.admitted(latched, ["topic"], ["ingest_seq"], "micros", 9_000, latching=False, name="open")
    return both.groupBy("topic").agg(F.count_if("latched").alias("n_latched"), F.count_if("open").alias("n_open"), F.count(F.lit(1)).alias("n"))


def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most 20 rows and of at most a day, per topic."""
    e = ev.envelope(spark, d).select("topic", "ingest_seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    got = folds.micro_batches(e, ["topic"], ["ingest_seq"], "ms", 20, 86_400_000)
    n = got.groupBy("topic", "batch").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("topic").agg(F.count(F.lit(1)).alias("n_batches"), F.max("n").alias("most"), F.min("n").alias("least"))


def fan_out_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each batch that find room in a consumer's queue of three."""
    got = routing.within_capacity(table(spark, d, "deliveries").select("consumer_id", "batch_no", "delivery_id"), ["consumer_id", "batch_no"], "delivery_id", 3)
    return got.groupBy("consumer_id").agg(F.count_if("sent").alias("n_sent"), F.count_if(~F.col("sent")).alias("n_full"))


OVERRIDES = [("event.error.>", 3), ("event.*.u1", 7), ("event.>", 4)]


def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    failed = ev._tracked(spark, d).withColumn("failed_at", F.col("delivered_at"))
    got = delivery.redeliveries(failed, spark.createDataFrame(OVERRIDES, "pattern string, most int"))
    return got.groupBy("decision", "next_attempt").agg(F.count(F.lit(1)).alias("n"), F.min("due_at").alias("first_due"), F.max("due_at").alias("last_due"))


def subscription_ttl(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "deliveries").groupBy("sub_id").agg(F.max("delivered_at").alias("seen_at"))
    return delivery.live_subscriptions(seen, seen.select(F.max("seen_at")).scalar(), 12)


def subscriptions_removed(spark: SparkSession, d: str) -> DataFrame:
    """Routed messages per subscription after some were removed by pattern and id."""
    subs = table(spark, d, "subscriptions").select("sub_id", "consumer_id", F.col("topic_pattern").alias("pattern"))
    gone = subs.where("sub_id in ('sub-000', 'sub-002')").unionByName(subs.where("sub_id = 'sub-003'").withColumn("pattern", F.lit("other")))
    got = topics.route(table(spark, d, "pub_messages").select("ingest_seq", "topic"), topics.without(subs, gone, ["pattern", "sub_id"]))
    return got.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"))


def priority_order(spark: SparkSession, d: str) -> DataFrame:
    """Retried messages first within their topic."""
    m = table(spark, d, "pub_messages").select("ingest_seq", "topic", F.map_contains_key("headers", "x-retry").cast("int").alias("priority"))
    return numbering.by_priority(m, ["topic"], "priority", "ingest_seq").select("ingest_seq", "topic", "rn")


REGISTRY = [(k, f"svc{i}", f"key-{k}-{i}") for k in ("click", "view", "error") for i in range(3)]


def request_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of refused requests: unknown namespace, wrong key, no topic, too large, not granted."""
    i = F.col("ingest_seq")
    svc = F.concat(F.lit("svc"), (i % 4).cast("string"))
    e = ev.envelope(spark, d).select(
        "ingest_seq", F.col("event_type").alias("ns"), svc.alias("service_id"), F.when(i % 7 != 0, F.concat(F.lit("key-"), "event_type", F.lit("-"), (i % 4).cast("string"))).alias("api_key"),
        F.when(i % 11 != 0, F.col("topic")).otherwise("").alias("topic"), F.round("value").cast("int").alias("size"),
    )
    known = access.authenticate(e, spark.createDataFrame(REGISTRY, "ns string, service_id string, api_key string"))
    acl = spark.createDataFrame([("svc0", ">"), ("svc1", "event.view.*"), ("svc2", "event.*.u5")], "service_id string, pattern string")
    return access.refused(known, acl, ["service_id"], "size", 200).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("ingest_seq").alias("sum_seq"))


def group_least_loaded(spark: SparkSession, d: str) -> DataFrame:
    """With equal costs the least loaded member is the one whose turn it is."""
    e, m = ev._grouped(spark, d)
    return groups.least_loaded(e.select("ingest_seq", "grp", F.lit(1).alias("cost")), m, "joined", "cost").select("ingest_seq", "grp", "member")


def handler_acks(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgements of a handler that rejects large attempts."""

    def handler(row: dict) -> None:
        if row["attempt"] > 4:
            raise ValueError(f"attempt {row['attempt']}")

    got = delivery.handle(ev._tracked(spark, d).select("msg_id", "consumer_id", "attempt"), handler)
    return got.groupBy("consumer_id", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


def broker_flow(spark: SparkSession, d: str) -> DataFrame:
    """Publish half of pub_messages, subscribe, publish all of it, deliver, acknowledge every third delivery: what is
    pending for each consumer."""
    b = broker.temporary(spark)
    m = table(spark, d, "pub_messages").select("ingest_seq", "msg_id", "topic", "payload", "headers")
    half = m.select(F.floor(F.max("ingest_seq") / 2)).first()[0] or 0
    b.publish(m.where(F.col("ingest_seq") <= half), "ingest_seq")
    b.subscribe("s1", "all", ">", position="earliest")
    b.subscribe("s2", "orders", "order.>", filter="payload.total > 50")
    b.subscribe("s3", "gone", "*")
    b.unsubscribe("s3")
    b.publish(m, "ingest_seq")
    out = b.deliver()
    b.ack(out.where("ingest_seq % 3 = 0").select("msg_id", "consumer_id", F.lit("done").alias("status")))
    return b.pending().groupBy("consumer_id").agg(F.count(F.lit(1)).alias("n"))


# statistics


def rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    return stats.sliding_rate(ev.envelope(spark, d), "ts", ["event_type"], "1 hour", "30 minutes", 3600)


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(ev.envelope(spark, d), ["event_type"], "value", BOUNDS)


def latency_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    b = stats.histogram(ev.envelope(spark, d), ["event_type"], "value", BOUNDS)
    got = [stats.histogram_quantile(b, ["event_type"], q, n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p999", 0.999))]
    return got[0].join(got[1], "event_type").join(got[2], "event_type")


def load_test_stats(spark: SparkSession, d: str) -> DataFrame:
    e = ev.envelope(spark, d).withColumn("micros", F.round(F.col("value") * 100).cast("bigint"))
    return stats.load_test(e, ["event_type"], F.col("user_id") % 10 != 0, "micros", "ts")


def namespace_service_counts(spark: SparkSession, d: str) -> DataFrame:
    """Services added and removed, never below none."""
    e = ev.envelope(spark, d)
    return stats.saturating_counts(e, ["event_type"], "ingest_seq", F.when(F.col("user_id") % 5 < 2, 1).otherwise(-1), block=1024)


def _member_log(spark: SparkSession, d: str) -> DataFrame:
    return ev.envelope(spark, d).select(F.col("event_type").alias("grp"), F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string")).alias("consumer_id"), F.when(F.col("ingest_seq") % 3 == 0, "remove").otherwise("add").alias("op"), "ingest_seq")


def group_member_counts(spark: SparkSession, d: str) -> DataFrame:
    return groups.members_after(_member_log(spark, d), "ingest_seq").groupBy("grp").agg(F.count(F.lit(1)).alias("n_members"), F.max("joined").alias("last_joined"))


def _topology(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("joined", "suspect", "dead", "recovered", "dead"))), (F.col("ingest_seq") % 5 + 1).cast("int"))
    return ring.nodes_after(ev.envelope(spark, d).select("ingest_seq", F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")).alias("node"), kind.alias("event")), "ingest_seq")


def topology_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d)


def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("ack_status").isNull(), "in_flight").when((F.col("ack_status") == "rejected") & (delivery.decide(F.coalesce("attempt", F.lit(1)), 5) == "dlq"), "dlq")
    rows = table(spark, d, "deliveries").select(state.alias("state"))
    return stats.cluster_counts(rows, groups.members_after(_member_log(spark, d), "ingest_seq"), _topology(spark, d).where("in_ring"))


def metrics_lines(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "deliveries").groupBy("consumer_id", "ack_status").agg(F.count(F.lit(1)).alias("n"))
    return stats.metrics_text(n, "deliveries_total", ["consumer_id", "ack_status"], "n")


# logs and frames


def _log(spark: SparkSession, d: str) -> DataFrame:
    """pub_messages written as log segments to the shared folder and read back; a completion follows every third write."""
    m = wal.with_shard(table(spark, d, "pub_messages").select("topic", "ingest_seq", "payload", canonical_id("msg_id").alias("msg_id")), 8)
    done = m.where("ingest_seq % 3 = 0").select("shard", (F.col("ingest_seq") * 2 + 1).alias("seq"), F.lit("completion").alias("rec_type"), "msg_id", F.encode(F.lit("c-1"), "utf-8").alias("data"))
    rows = m.select("shard", (F.col("ingest_seq") * 2).alias("seq"), F.lit("event_write").alias("rec_type"), "msg_id", F.encode(F.coalesce("payload", F.lit("")), "utf-8").alias("data")).unionByName(done)
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    materialize(wal.write_log(rows, root, segment_bytes=64 << 10), "log-segments")
    spark.dataSource.register(wal.WalSource)
    return spark.read.format("streamroute_wal").load(root)


def wal_log_scan(spark: SparkSession, d: str) -> DataFrame:
    got = _log(spark, d).groupBy("shard", "rec_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("msg_id").alias("n_ids"), F.sum("rec_len").alias("n_bytes"), F.sum(F.coalesce(F.octet_length("payload"), F.lit(0))).alias("payload_bytes"))
    return got


FRAME_KINDS = ["pub", "ack", "ping", "pong", "sub", "unsub", "flow", "err", "connect", "connack"]


def frame_scan(spark: SparkSession, d: str) -> DataFrame:
    """Frames of one captured stream a batch. In some the last checksum is broken, in some the last frame is cut off, in
    some the first magic number is wrong."""
    kind = F.element_at(F.array(*map(F.lit, FRAME_KINDS)), (F.col("ingest_seq") % len(FRAME_KINDS) + 1).cast("int"))
    m = table(spark, d, "pub_messages").select("batch_no", "ingest_seq", kind.alias("frame_type"), (F.col("ingest_seq") % 16).alias("flags"), canonical_id("msg_id").alias("msg_id"), F.encode(F.coalesce("payload", F.lit("")), "utf-8").alias("payload"))
    c, turn, n = F.col("content"), F.col("name").cast("bigint") % 4, F.octet_length("content")
    end = F.when(F.hex(F.substring(c, -1, 1)) == "00", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    broken = F.when(turn == 1, F.concat(F.expr("substring(content, 1, octet_length(content) - 1)"), end)).when(turn == 2, F.expr("substring(content, 1, octet_length(content) - 3)"))
    broken = broken.when(turn == 3, F.concat(F.unhex(F.lit("FF")), F.expr("substring(content, 2, octet_length(content) - 1)"))).otherwise(c)
    frames = wal.read_frames(wal.frames_of(m, F.col("batch_no"), "ingest_seq").where(n > 0).withColumn("content", broken))
    return frames.groupBy("code", F.when(F.col("code") == "", F.col("frame_type")).otherwise("").alias("frame_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("code") == "", F.col("flags")).otherwise(0)).alias("sum_flags"), F.sum(F.octet_length("payload")).alias("payload_bytes"))


def msgpack_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "pub_messages").select("ingest_seq", wal.unpacked(wal.packed(F.col("payload"))).alias("j"))
    field = lambda p: F.get_json_object("j", p)
    return m.select("ingest_seq", F.col("j").isNotNull().alias("ok"), field("$.n").cast("bigint").alias("n"), field("$.order_id").alias("order_id"), field("$.v").cast("double").alias("v"), field("$.amount").cast("double").alias("amount"))


# control files and filters

ROUTES = """
routes:
  - name: dear
    match: {topic: "event.purchase.*", where: "payload.value > 60"}
    transform: [{set: "payload.level = 'high'"}, {rename: "user_id -> buyer.id"}]
    deliver: [{service: billing}, {service: fraud, where: "value > 150"}]
  - name: paused
    enabled: false
    match: {topic: ">"}
    deliver: [{service: never}]
namespaces:
  - name: shop
    services:
      - {name: reader, permissions: {subscribe: ["event.>"], publish: []}}
      - {name: writer, permissions: {publish: ["event.purchase.>", "event.click.u1"]}}
"""


def config_routes(spark: SparkSession, d: str) -> DataFrame:
    got = routing.apply_rules(ev._variant(spark, d), config.rules(ROUTES), VariantFields("data"), payload_json="body")
    return got.select("ingest_seq", "rule", "service", F.get_json_object("body", "$.level").alias("level"), F.get_json_object("body", "$.buyer.id").cast("bigint").alias("buyer"), F.get_json_object("body", "$.user_id").alias("user_id"))


def config_grants(spark: SparkSession, d: str) -> DataFrame:
    """Topics that the services of a control file may publish to."""
    acl = config.grants(spark, ROUTES).where("action = 'publish'").select("service", "pattern")
    who = F.when(F.col("ingest_seq") % 2 == 0, "writer").otherwise("reader").alias("service")
    return topics.permitted(ev.envelope(spark, d).select("ingest_seq", "topic", who), acl, ["service"])


def filter_array(spark: SparkSession, d: str) -> DataFrame:
    return ev._filters(spark, d, {"eq": 'tags == ["a", "b"]', "ne": 'tags != ["a"]', "lacking_ne": "nothing != [1]", "lacking_eq": "nothing == [1]", "null_ne": "k != [1]"})


BAD_FILTERS = ["", "a >", "a > 1.2.3", "foo(a, 1)", "a > 'x", "(a > 1", "> 1", "a && b", "NOT", "a > 1 garbage", "in(a, [1, 2", "a > >"]


def filter_errors(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of errors of filters that don't compile; '' for those that do."""

    def error(text: str) -> str:
        try:
            compile_filter(text, VariantFields("data"))
        except FilterError as e:
            return type(e).__name__
        return ""

    return spark.createDataFrame([(t, error(t)) for t in BAD_FILTERS], "text string, error string")


def filter_raw(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of raw bytes pass content filters."""
    e = ev._variant(spark, d).withColumn("enc", F.when(F.col("ingest_seq") % 4 == 0, "raw").when(F.col("ingest_seq") % 4 == 1, "json"))
    rules = [routing.Rule("r", "event.view.>", [routing.Target("a"), routing.Target("b", where="value > 100")], where="value > 50")]
    return routing.apply_rules(e, rules, VariantFields("data"), encoding="enc").select("ingest_seq", "service")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_tiered_counts, batch_hole, consumer_handler_order, group_least_loaded, handler_acks, broker_flow, admission_decisions, micro_batches, fan_out_capacity, retry_schedule, subscription_ttl, subscriptions_removed, priority_order, request_codes, rate_sliding,
        latency_histogram, latency_histogram_quantile, load_test_stats, namespace_service_counts, group_member_counts, topology_nodes, cluster_counts, metrics_lines, wal_log_scan, frame_scan,
        msgpack_round_trip, config_routes, config_grants, filter_array, filter_errors, filter_raw,
    )
}

# SQL --------------------------------------------------------------------------------------------------------------

_EV, _TR = ev._EV, ev._TR
_MID = canonical_sql("msg_id")
_BUCKETS = f"""b as (select event_type, u.le, count(*) filter (where value <= u.le) as n from ev, (select unnest([{', '.join(map(str, BOUNDS))}, 'inf'::double]) as le) u group by 1, 2)"""


def _quantile_sql(q: float) -> str:
    return f"""(select event_type, case when le = 'inf'::double then low else low + (le - low) * (rank - before) / (n - before) end as v from (
        select *, row_number() over (partition by event_type order by le) as i from (
          select event_type, le, n, coalesce(lag(le) over w, 0.0) as low, coalesce(lag(n) over w, 0) as before, {q}::double * max(n) over (partition by event_type) as rank from b window w as (partition by event_type order by le)) where n >= rank)
        where i = 1)"""


_LOG = f"m as (select ingest_seq, {_MID} as mid, coalesce(payload, '') as payload, cast(coalesce({ev._H.format('topic')} % 8, 0) as int) as shard from pub_messages)"
_KIND = "[" + ", ".join(f"'{k}'" for k in FRAME_KINDS) + "]"
_OPS = "l as (select event_type as grp, 'm' || cast(user_id % 50 as varchar) as consumer_id, case when ingest_seq % 3 = 0 then 'remove' else 'add' end as op, ingest_seq from ev), mem as (select grp, consumer_id, max(ingest_seq) as joined from l group by 1, 2 having arg_max(op, ingest_seq) = 'add')"
_TOPO = """t as (select ingest_seq, 'n' || cast(user_id % 7 as varchar) as node, ['joined', 'suspect', 'dead', 'recovered', 'dead'][ingest_seq % 5 + 1] <> 'dead' as inn from ev where ingest_seq % 5 <> 1),
  u as (select *, coalesce(lag(inn) over (partition by node order by ingest_seq), false) as was from t), nodes as (select node, arg_max(inn, ingest_seq) as in_ring, count(*) filter (where inn <> was) as changes from u group by 1)"""
_ERRORS = ["FilterEnd", "FilterEnd", "FilterParse", "FilterParse", "FilterParse", "FilterParse", "FilterEnd", "FilterParse", "FilterEnd", "", "FilterParse", "FilterToken"]

SQL = {
    "dedup_tiered_counts": ev._DUP + " select m.mode, case when rn = 1 then 'stored' else 'duplicate' end as status, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from r, (values ('memory'), ('balanced'), ('durable')) m(mode) group by 1, 2",
    "batch_hole": f"""with r as (select ingest_seq, batch_no, {_MID} as mid from pub_messages), f as (select mid, min(batch_no) as b from r where mid is not null group by 1)
        select case when batch_no > b then 'duplicate' else 'stored' end as status, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from r left join f using (mid) group by 1""",
    "consumer_handler_order": f"""with r as (select consumer_id, delivery_id, {_MID} as mid, coalesce(ack_status in ('done', 'ok'), false) as ok from deliveries),
        n as (select consumer_id, mid is null or row_number() over w = 1 as b, mid is null or not coalesce(bool_or(ok) over (partition by consumer_id, mid order by delivery_id rows between unbounded preceding and 1 preceding), false) as a
          from r window w as (partition by consumer_id, mid order by delivery_id))
        select consumer_id, count(*) filter (where b) as n_before, count(*) filter (where a) as n_after from n group by 1""",
    "group_least_loaded": ev.SQL["group_round_robin"],
    "handler_acks": f"""with {_EV}, {_TR} select consumer_id, case when attempt > 4 then 'rejected' else 'done' end as status, case when attempt > 4 then 'attempt ' || cast(attempt as varchar) end as reason, count(*) as n from d group by 1, 2, 3""",
    "broker_flow": f"""with m as (select ingest_seq, {_MID} as mid, topic, case when json_valid(payload) then cast(payload as json) end as js from pub_messages),
        half as (select coalesce(floor(max(ingest_seq) / 2), 0) as h from pub_messages),
        k as (select *, ingest_seq > h as late, row_number() over (partition by mid order by ingest_seq) as rn from m, half where coalesce(topic, '') <> '' and mid is not null)
        select u.consumer_id, count(*) as n from k, (values ('all'), ('orders')) u(consumer_id)
        where rn = 1 and (ingest_seq + case when late then 1099511627776 else 0 end) % 3 <> 0 and (u.consumer_id = 'all' or late and starts_with(topic, 'order.')
          and coalesce(json_type(js, '$.total') in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(js->>'$.total' as double) > 50, false)) group by 1""",
    "admission_decisions": f"""with recursive {_EV}, n as (select topic, cast(round(value * 100) as bigint) as x, row_number() over (partition by topic order by ingest_seq) rn from ev),
        f as (select topic, rn, x as ema from n where rn = 1 union all select n.topic, n.rn, case when f.ema = 0 then n.x else (f.ema * 9 + n.x) // 10 end from f join n on n.topic = f.topic and n.rn = f.rn + 1),
        p as (select topic, rn, coalesce(lag(ema) over (partition by topic order by rn), 0) as prev from f),
        q as (select topic, prev, max(prev) over (partition by topic order by rn) as most from p)
        select topic, count(*) filter (where most < 9000) as n_latched, count(*) filter (where prev < 9000) as n_open, count(*) as n from q group by 1""",
    "micro_batches": f"""with recursive {_EV}, n as (select topic, epoch_ms(ts) as ms, row_number() over (partition by topic order by ingest_seq) rn from ev),
        f as (select topic, rn, 0 as no, 1 as held, ms as began from n where rn = 1
          union all select n.topic, n.rn, f.no + case when f.held >= 20 or n.ms > f.began + 86400000 then 1 else 0 end, case when f.held >= 20 or n.ms > f.began + 86400000 then 1 else f.held + 1 end,
            case when f.held >= 20 or n.ms > f.began + 86400000 then n.ms else f.began end from f join n on n.topic = f.topic and n.rn = f.rn + 1),
        b as (select topic, no, count(*) as n from f group by 1, 2)
        select topic, count(*) as n_batches, max(n) as most, min(n) as least from b group by 1""",
    "fan_out_capacity": """with n as (select consumer_id, row_number() over (partition by consumer_id, batch_no order by delivery_id) as place from deliveries)
        select consumer_id, count(*) filter (where place <= 3) as n_sent, count(*) filter (where place > 3) as n_full from n group by 1""",
    "retry_schedule": f"""with {_EV}, {_TR}, l as (select *, case when split_part(topic, '.', 3) = 'u1' then 7 when starts_with(topic, 'event.error.') then 3 else 4 end as most from d),
        x as (select case when attempt + 1 >= most then 'dlq' else 'retry' end as decision, attempt + 1 as nxt, delivered_at + to_seconds(least(pow(2, attempt), 60)) as due from l)
        select decision, case when decision = 'retry' then nxt end as next_attempt, count(*) as n, min(due) filter (where decision = 'retry') as first_due, max(due) filter (where decision = 'retry') as last_due from x group by 1, 2""",
    "subscription_ttl": """with s as (select sub_id, max(delivered_at) as seen_at from deliveries group by 1)
        select sub_id, seen_at from s where seen_at is null or seen_at >= (select max(seen_at) from s) - interval 12 hours""",
    "subscriptions_removed": f"with {ev._PUB_SUB} select sub_id, count(*) as n from pub_messages m join s on regexp_full_match(m.topic, s.rx) where sub_id not in ('sub-000', 'sub-002') group by 1",
    "priority_order": """select ingest_seq, topic, row_number() over (partition by topic order by case when headers is null then -1 when list_contains(map_keys(headers), 'x-retry') then 1 else 0 end desc, ingest_seq) as rn from pub_messages""",
    "request_codes": f"""with {_EV}, r as (select ingest_seq, event_type as ns, ingest_seq % 4 as i, ingest_seq % 7 <> 0 as keyed, case when ingest_seq % 11 <> 0 then topic else '' end as topic, cast(round(value) as int) as size from ev),
        c as (select ingest_seq, case when ns not in ('click', 'view', 'error') then 4040 when i > 2 or not keyed then 4010 when topic = '' then 4000 when size > 200 then 4090
          when not (i = 0 or i = 1 and starts_with(topic, 'event.view.') or i = 2 and split_part(topic, '.', 3) = 'u5') then 4030 end as code from r)
        select cast(code as int) as code, count(*) as n, cast(sum(ingest_seq) as bigint) as sum_seq from c group by 1""",
    "rate_sliding": f"""with {_EV}, w as (select event_type, time_bucket(interval '30 minutes', ts) - back * interval '30 minutes' + interval '1 hour' as window_end from ev, (values (0), (1)) u(back))
        select window_end, event_type, count(*) as n, count(*) / 3600.0::double as rate from w group by 1, 2""",
    "latency_histogram": f"with {_EV}, {_BUCKETS} select * from b",
    "latency_histogram_quantile": f"with {_EV}, {_BUCKETS} select a.event_type, a.v as p50, c.v as p90, e.v as p999 from {_quantile_sql(0.5)} a join {_quantile_sql(0.9)} c using (event_type) join {_quantile_sql(0.999)} e using (event_type)",
    "load_test_stats": f"""with {_EV}, l as (select event_type, ts, cast(round(value * 100) as bigint) as x, user_id % 10 <> 0 as ok from ev)
        select event_type, count(*) as n, count(*) filter (where ok) as n_ok, count(*) filter (where not ok) as n_error, count(*) filter (where not ok) / count(*) as error_rate,
          count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) as per_second, min(x) filter (where ok) as least, avg(x) filter (where ok) as mean, max(x) filter (where ok) as most from l group by 1""",
    "namespace_service_counts": f"""with {_EV}, s as (select event_type, ingest_seq, sum(case when user_id % 5 < 2 then 1 else -1 end) over (partition by event_type order by ingest_seq) as s from ev)
        select event_type, cast(arg_max(s, ingest_seq) - least(0, min(s)) as bigint) as n from s group by 1""",
    "group_member_counts": f"with {_EV}, {_OPS} select grp, count(*) as n_members, max(joined) as last_joined from mem group by 1",
    "topology_nodes": f"with {_EV}, {_TOPO} select * from nodes",
    "cluster_counts": f"""with {_EV}, {_OPS}, {_TOPO} select count(*) filter (where ack_status is null) as in_flight, count(*) filter (where ack_status = 'rejected' and coalesce(attempt, 1) + 1 >= 5) as dead_lettered,
        (select count(*) from mem) as members, (select count(*) from nodes where in_ring) as nodes from deliveries""",
    "metrics_lines": """select 'deliveries_total{' || concat_ws(',', 'consumer_id="' || consumer_id || '"', 'ack_status="' || ack_status || '"') || '} ' || cast(count(*) as varchar) as line from deliveries group by consumer_id, ack_status""",
    "wal_log_scan": f"""with {_LOG}, r as (select shard, 'event_write' as rec_type, mid, strlen(payload) as size, strlen(payload) as p from m where mid is not null union all select shard, 'completion', mid, 3, 0 from m where mid is not null and ingest_seq % 3 = 0)
        select shard, rec_type, count(*) as n, count(distinct mid) as n_ids, cast(sum(25 + size) as bigint) as n_bytes, cast(sum(p) as bigint) as payload_bytes from r group by 1, 2""",
    "frame_scan": f"""with m as (select ingest_seq, batch_no, {_MID} as mid, coalesce(payload, '') as payload from pub_messages),
        f as (select batch_no % 4 as turn, {_KIND}[ingest_seq % {len(FRAME_KINDS)} + 1] as frame_type, ingest_seq % 16 as flags, strlen(payload) as p,
          row_number() over (partition by batch_no order by ingest_seq) as a, row_number() over (partition by batch_no order by ingest_seq desc) as z from m where mid is not null and batch_no is not null),
        g as (select case when turn = 1 and z = 1 then '4001' when turn = 3 then '4000' else '' end as code, * from f where not (turn = 2 and z = 1) and not (turn = 3 and a > 1))
        select code, case when code = '' then frame_type else '' end as frame_type, count(*) as n, cast(sum(case when code = '' then flags else 0 end) as bigint) as sum_flags, cast(sum(case when code = '' then p else 0 end) as bigint) as payload_bytes from g group by 1, 2""",
    "msgpack_round_trip": """select ingest_seq, coalesce(json_valid(payload), false) as ok, case when json_valid(payload) then try_cast(json_extract_string(payload, '$.n') as bigint) end as n,
        case when json_valid(payload) then json_extract_string(payload, '$.order_id') end as order_id, case when json_valid(payload) then try_cast(json_extract_string(payload, '$.v') as double) end as v,
        case when json_valid(payload) then try_cast(json_extract_string(payload, '$.amount') as double) end as amount from pub_messages""",
    "config_routes": f"""with {_EV} select ingest_seq, 'dear' as rule, s.service, 'high' as level, user_id as buyer, cast(null as varchar) as user_id from ev, (values ('billing', 60), ('fraud', 150)) s(service, least)
        where event_type = 'purchase' and value > least""",
    "config_grants": f"with {_EV} select ingest_seq, topic, 'writer' as service from ev where ingest_seq % 2 = 0 and (event_type = 'purchase' or topic = 'event.click.u1')",
    "filter_array": f"with {_EV} select ingest_seq, false as eq, false as ne, true as lacking_ne, false as lacking_eq, turn = 0 as null_ne from ev",
    "filter_errors": "select * from (values " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{e}')" for t, e in zip(BAD_FILTERS, _ERRORS)) + ") v(text, error)",
    "filter_raw": f"""with {_EV} select ingest_seq, s.service from ev, (values ('a', 50), ('b', 100)) s(service, least) where event_type = 'view' and (value > least or ingest_seq % 4 = 0)""",
}
