"""Queries over the broker tables (problems of the core part) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute.functions.msgid import canonical_id, canonical_sql
from streamroute.operators import dedup, drift, incremental, nested, skew
from streamroute.session import join_small, shared_dir, table



def _arrival() -> list:
    return [F.col(c).asc_nulls_last() for c in ("attempt", "delivered_at", "delivery_id")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_links(nested.nodes(table(spark, d, "raw_requests")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return nested.groups(nested.nodes(table(spark, d, "raw_requests")))


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows, values and characters of every column of every flat table."""
    return nested.table_profiles(nested.flat_tables(table(spark, d, "raw_requests")))


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.pivot_group(nested.nodes(table(spark, d, "raw_requests")), "data.items[]", ["sku", "qty", "quantity"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.file_statistics(table(spark, d, "raw_requests")))


def p2_path_types(spark: SparkSession, d: str) -> DataFrame:
    """How many events of a gateway's topic and file carry a path, and with which types."""
    st = drift.file_statistics(table(spark, d, "raw_requests"))
    n = lambda s: F.coalesce(F.sum(F.when(F.col("stat") == s, F.col("n"))), F.lit(0))
    kept = st.where("path <> '' and (stat = 'has' or startswith(stat, 'type:'))")
    return kept.groupBy("gateway_id", "topic", "file_no", "path").agg(n("has").alias("n_events"), *[n(f"type:{k}").alias(f"n_{k}") for k in ("string", "number", "boolean")])


def p2_casts(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "raw_requests")
    return drift.cast_report(drift.consistent_values(requests, drift.changes(drift.file_statistics(requests))))


def p2_casts_as_named(spark: SparkSession, d: str) -> DataFrame:
    """The cast report under the names that topics and fields have in the files, renames left aside."""
    requests = table(spark, d, "raw_requests")
    return drift.cast_report(drift.consistent_values(requests, spark.createDataFrame([], drift.CHANGES)))


def p2_orders(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of one topic over all gateways and files."""
    requests = table(spark, d, "raw_requests")
    values = drift.consistent_values(requests, drift.changes(drift.file_statistics(requests)))
    return drift.consistent_table(values, "order.created", {"order_id": "string", "customer": "string", "total": "number", "express": "boolean", "items[].sku": "string"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "deliveries").select("delivery_id", "attempt", "delivered_at", "consumer_id", canonical_id("msg_id").alias("mid"))
    rows = rows.where("mid is not null and consumer_id is not null")
    return dedup.mark_copies(rows, [F.col("mid"), F.col("consumer_id")], _arrival()).where("is_copy").select("delivery_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "deliveries").select("delivery_id", "attempt", "delivered_at", "consumer_id", canonical_id("msg_id").alias("mid"))
    return dedup.keep_first(rows, [F.col("mid"), F.col("consumer_id")], _arrival()).select("delivery_id", F.col("mid").alias("message"), "consumer_id")


def p3_new_batches(spark: SparkSession, d: str) -> DataFrame:
    """The last tenth of the batches against the identifiers of all earlier ones."""
    rows = table(spark, d, "deliveries").select("delivery_id", "batch_no", "attempt", "delivered_at", "consumer_id", canonical_id("msg_id").alias("mid"))
    cut = rows.select(F.floor(F.max("batch_no") * 0.9)).scalar()
    stored = rows.where((F.col("batch_no") <= cut) & F.col("mid").isNotNull() & F.col("consumer_id").isNotNull())
    stored = stored.select(F.col("mid").alias("message"), F.col("consumer_id").alias("consumer")).distinct()
    fresh = dedup.fresh_rows(rows.where(F.col("batch_no") > cut), stored, [F.col("mid"), F.col("consumer_id")], _arrival(), ["message", "consumer"])
    return fresh.select("delivery_id", "message", "consumer")


def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries in three runs, each against the identifiers that the runs before have stored: rows kept a run."""
    rows = table(spark, d, "deliveries").select("delivery_id", "batch_no", "attempt", "delivered_at", "consumer_id", canonical_id("msg_id").alias("mid"))
    third = F.least(F.floor(F.col("batch_no") * 3 / F.greatest(F.lit(1), rows.select(F.max("batch_no") + 1).scalar())), F.lit(2)).cast("int")
    rows = rows.withColumn("run", F.coalesce(third, F.lit(0)))
    store = dedup.SeenStore(spark, f"{shared_dir(spark)}/seen-ids-{uuid.uuid4().hex}", [F.col("mid"), F.col("consumer_id")], _arrival(), ["message", "consumer"])
    kept = [store.take(i, rows.where(F.col("run") == i)).select("run", "delivery_id", "message", "consumer") for i in range(3)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.records_since(table(spark, d, "wal_records"), table(spark, d, "replica_marks"))


def p4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of every segment's records."""
    rows = incremental.whole_records(table(spark, d, "wal_records"))
    return incremental.fingerprints(rows, incremental.SEGMENT, F.col("content"))


def p4_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rows and repairs of every segment, kept by two runs: the first sees the records as first written, the second all.
    recomputed tells the segments that the second one had to do."""
    r = table(spark, d, "wal_records").where("shard is not null and segment is not null")
    count = lambda df: df.groupBy(*incremental.SEGMENT).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("revision") > 0).alias("n_repairs"))
    t = incremental.IncrementalTable(spark, f"{shared_dir(spark)}/two-runs-{uuid.uuid4().hex}", incremental.SEGMENT, [*incremental.RECORD_COLUMNS, "scan_no"], count)
    t.refresh(r.where("coalesce(revision, 0) = 0"))
    again = t.refresh(r).withColumn("recomputed", F.lit(True))
    return join_small(t.read(), again, incremental.SEGMENT, "left").fillna(False, ["recomputed"])


def _topics(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "pub_messages").select(F.lit("pub_messages").alias("table_name"), "topic")
    return one.unionByName(table(spark, d, "deliveries").select(F.lit("deliveries").alias("table_name"), "topic"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_topics(spark, d), "table_name", "topic", 0.05).select("table_name", "topic")


def p5_topic_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "deliveries").select("topic", "consumer_id", "attempt", "delivered_at", canonical_id("msg_id").alias("mid"))
    base = skew.aggregate_keys(
        rows,
        ["topic"],
        {
            "n_rows": F.count(F.lit(1)),
            "n_redelivered": F.count_if(F.col("attempt") > 1),
            "sum_attempts": F.sum(F.col("attempt").cast("bigint")),
            "first_at": F.min("delivered_at"),
            "last_at": F.max("delivered_at"),
        },
    )
    ids = skew.distinct_per_key(rows, ["topic"], F.col("mid"), "n_messages")
    return base.join(ids.withColumnRenamed("topic", "t"), F.col("topic").eqNullSafe(F.col("t"))).drop("t")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p1_tables, p1_items, p2_found, p2_path_types, p2_casts, p2_casts_as_named, p2_orders, p3_found, p3_kept, p3_new_batches, p3_batches, p4_found, p4_fingerprints, p4_two_runs, p5_found, p5_topic_stats)}

#: Events of the bodies, their data, and every value in it with its path (keys without their quotes).
_BODIES = r"""
        ev as (
          select request_id, e.no as event_no, e.js as js from (
            select request_id, case when json_type(body, '$.events') = 'ARRAY'
              then list_transform(generate_series(0, cast(json_array_length(body, '$.events') as bigint) - 1), lambda i: {'no': i, 'js': json_extract(body, '$.events[' || i || ']')})
              else [{'no': 0::bigint, 'js': body::json}] end as es
            from raw_requests where json_valid(body) and json_type(body) = 'OBJECT' and not regexp_matches(body, '(NaN|Infinity)')) t, unnest(es) as u(e)),
        dt as (
          select request_id, event_no, js,
            case when json_type(js, '$.data') = 'VARCHAR' and json_valid(js->>'$.data') and json_type(js->>'$.data') = 'OBJECT' then (js->>'$.data')::json else js->'$.data' end as data
          from ev where json_type(js) = 'OBJECT'),
        hd as (
          select request_id, event_no, k, js->'$.headers'->>k as v from dt, unnest(json_keys(js, '$.headers')) as u(k) where json_type(js, '$.headers') = 'OBJECT'),
        tr as (
          select request_id, event_no, t.type, t.atom->>'$' as v, 'data' || substr(regexp_replace(t.fullkey, '\."([^"]*)"', '.\1', 'g'), 2) as path
          from dt, json_tree(data) t where data is not null and json_type(data) <> 'NULL'),
        nd as (
          select request_id, event_no, path as node, coalesce(nullif(regexp_extract(path, '^(.*\])\.', 1), ''), 'data') as parent
          from tr where type = 'OBJECT' and suffix(path, ']')),
        grps as (
          select regexp_replace(node, '\[\d+\]', '[]', 'g') as grp, count(*) as n_rows from (
            select node from nd union all select path from tr where path = 'data' or type not in ('OBJECT', 'ARRAY') and suffix(path, ']') union all select 'headers' from hd) group by 1),
        cells as (
          select regexp_replace(node, '\[\d+\]', '[]', 'g') as grp, case when path = node then '' else substr(path, length(node) + 2) end as field, type, v from (
            select *, case when suffix(path, ']') or path = 'data' then path else coalesce(nullif(regexp_extract(path, '^(.*\])\.', 1), ''), 'data') end as node
            from tr where type not in ('OBJECT', 'ARRAY'))
          union all select 'headers', 'name', 'VARCHAR', k from hd union all select 'headers', 'value', case when v is null then 'NULL' else 'VARCHAR' end, v from hd)"""

_MID = canonical_sql("msg_id")
SQL = {
    "p1_found": f"""
        with {_BODIES}
        select request_id, cast(event_no as int) as event_no, node as node_path, parent as parent_path from nd
        union all select request_id, cast(event_no as int), 'headers.' || k, 'headers' from hd""",
    "p1_groups": f"""
        with {_BODIES}
        select grp, field, count(*) as n, count(*) filter (where type = 'VARCHAR') as n_string, count(*) filter (where type in ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')) as n_number,
          count(*) filter (where type = 'BOOLEAN') as n_boolean, count(*) filter (where type = 'NULL') as n_null from cells group by 1, 2""",
    "p1_tables": f"""
        with {_BODIES}, f as (select grp, field, count(v) as n_values, cast(coalesce(sum(length(v)), 0) as bigint) as n_chars from cells group by 1, 2)
        select grp, field, n_rows, coalesce(n_values, 0) as n_values, coalesce(n_chars, 0) as n_chars from grps left join f using (grp)""",
    "p1_items": rf"""
        with {_BODIES}, i as (select request_id, event_no, node as node_path, parent as parent_path from nd where regexp_full_match(node, 'data\.items\[\d+\]')),
        c as (select request_id, event_no, regexp_extract(path, '^(.*\])\.', 1) as node_path, substr(path, length(regexp_extract(path, '^(.*\])\.', 1)) + 2) as field, v
              from tr where regexp_full_match(path, 'data\.items\[\d+\]\.(sku|qty|quantity)') and type not in ('OBJECT', 'ARRAY'))
        select i.*, max(v) filter (where field = 'sku') as sku, max(v) filter (where field = 'qty') as qty, max(v) filter (where field = 'quantity') as quantity
        from i left join c using (request_id, event_no, node_path) group by all""",
    "p2_path_types": f"""
        with {_BODIES}, own as (
          select gateway_id, js->>'$.topic' as topic, file_no, request_id, event_no from dt join raw_requests using (request_id)
          where json_type(js, '$.topic') = 'VARCHAR' and json_type(data) = 'OBJECT' and gateway_id is not null and file_no is not null),
        v as (
          select distinct request_id, event_no, regexp_replace(substr(path, 6), '\\[\\d+\\]', '[]', 'g') as path,
            case when type = 'VARCHAR' then 'string' when type = 'BOOLEAN' then 'boolean' else 'number' end as kind
          from tr where type not in ('OBJECT', 'ARRAY', 'NULL') and path <> 'data')
        select gateway_id, topic, file_no, path, count(distinct (request_id, event_no)) as n_events, count(*) filter (where kind = 'string') as n_string,
          count(*) filter (where kind = 'number') as n_number, count(*) filter (where kind = 'boolean') as n_boolean
        from own join v using (request_id, event_no) group by 1, 2, 3, 4""",
    "p2_casts_as_named": rf"""
        with {_BODIES}, own as (
          select js->>'$.topic' as topic, request_id, event_no from dt join raw_requests using (request_id)
          where json_type(js, '$.topic') = 'VARCHAR' and json_type(data) = 'OBJECT' and gateway_id is not null and file_no is not null),
        v as (
          select topic, regexp_replace(substr(path, 6), '\[\d+\]', '[]', 'g') as field_path, v, case when type = 'VARCHAR' then 'string' when type = 'BOOLEAN' then 'boolean' else 'number' end as kind
          from tr join own using (request_id, event_no) where type not in ('OBJECT', 'ARRAY', 'NULL') and path <> 'data'),
        n as (select topic, field_path, kind, count(*) as n from v group by 1, 2, 3),
        one as (select topic, field_path, arg_max(kind, (n, kind)) as type from n group by 1, 2)
        select topic, field_path, type, count(*) as n_values, count(*) filter (where kind <> type) as n_other_type, count(*) filter (where
            type = 'number' and not (regexp_matches(v, '{drift.DECIMAL}') and kind <> 'boolean') or type = 'boolean' and lower(v) not in ('true', 'false')) as n_failed
        from v join one using (topic, field_path) group by 1, 2, 3""",
    "p3_found": f"""
        select delivery_id from (
          select delivery_id, row_number() over (partition by mid, consumer_id order by attempt nulls last, delivered_at nulls last, delivery_id nulls last) rn
          from (select *, {_MID} as mid from deliveries) where mid is not null and consumer_id is not null) where rn > 1""",
    "p3_kept": f"""
        select delivery_id, mid as message, consumer_id from (
          select *, row_number() over (partition by mid, consumer_id order by attempt nulls last, delivered_at nulls last, delivery_id nulls last) rn
          from (select *, {_MID} as mid from deliveries)) where rn = 1 or mid is null or consumer_id is null""",
    "p3_new_batches": f"""
        with r as (select *, {_MID} as mid from deliveries), cut as (select cast(floor(max(batch_no) * 0.9) as bigint) c from deliveries),
        n as (select *, row_number() over (partition by mid, consumer_id order by attempt nulls last, delivered_at nulls last, delivery_id nulls last) rn
              from r where batch_no > (select c from cut))
        select delivery_id, mid as message, consumer_id as consumer from n
        where (rn = 1 or mid is null or consumer_id is null)
          and not exists (select 1 from r o where o.batch_no <= (select c from cut) and o.mid = n.mid and o.consumer_id = n.consumer_id)""",
    "p3_batches": f"""
        with r as (select *, {_MID} as mid, coalesce(cast(least(floor(batch_no * 3 / greatest(1, (select max(batch_no) + 1 from deliveries))), 2) as int), 0) as run from deliveries),
        n as (select *, row_number() over (partition by mid, consumer_id order by run, attempt nulls last, delivered_at nulls last, delivery_id nulls last) rn from r)
        select run, delivery_id, mid as message, consumer_id as consumer from n where rn = 1 or mid is null or consumer_id is null""",
    "p4_found": """
        with ok as (select *, row_number() over (partition by follower_id, shard order by run_no desc, last_segment desc, last_offset desc, confirmed_at desc) rn
                    from replica_marks where status = 'ok' and last_segment is not null and last_offset is not null),
        m as (select * from ok where rn = 1),
        f as (select distinct follower_id from replica_marks where follower_id is not null)
        select distinct f.follower_id, w.shard, w.segment, w.wal_offset
        from wal_records w cross join f left join m on m.follower_id = f.follower_id and m.shard = w.shard
        where w.shard is not null and w.segment is not null and w.wal_offset is not null
          and (m.follower_id is null or w.segment > m.last_segment or (w.segment = m.last_segment and w.wal_offset > m.last_offset)
               or (w.revision > 0 and w.written_at > m.confirmed_at))""",
    "p4_fingerprints": f"""
        with h as (select shard, segment, {incremental.row_hash_sql(incremental.RECORD_COLUMNS)} as h from wal_records
                   where shard is not null and segment is not null and wal_offset is not null)
        select shard, segment, count(*) as fp_rows, cast(sum(h >> 32) as bigint) as fp_high, cast(sum(h & 4294967295) as bigint) as fp_low from h group by 1, 2""",
    "p4_two_runs": """
        select shard, segment, count(*) as n_rows, count(*) filter (where revision > 0) as n_repairs, count(*) filter (where revision > 0) > 0 as recomputed
        from wal_records where shard is not null and segment is not null group by 1, 2""",
    "p5_found": """
        with t as (select 'pub_messages' as table_name, topic from pub_messages union all select 'deliveries', topic from deliveries),
        a as (select table_name, count(*) n from t group by 1)
        select t.table_name, topic from t join a using (table_name) where topic is not null and topic <> '' group by 1, 2, a.n having count(*) >= 0.05 * a.n""",
    "p5_topic_stats": f"""
        select topic, count(*) as n_rows, count(*) filter (where attempt > 1) as n_redelivered, cast(sum(attempt) as bigint) as sum_attempts,
          min(delivered_at) as first_at, max(delivered_at) as last_at, count(distinct {_MID}) as n_messages from deliveries group by 1""",
}
