import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamroute.operators import delivery, folds, groups, ring, routing, stats, transforms
from streamroute.operators.filters import FilterError, StructFields, VariantFields
from streamroute.operators.transforms import Op, apply_ops, op
from streamroute.sources import gateway, msgpack, wal
from streamroute.sources.crc32c import crc32c

CASES = [
    ([op("set", 'b = "hello"')], {"a": 1}, {"a": 1, "b": "hello"}), ([op("set", "a = 2")], {"a": 1}, {"a": 2}), ([op("remove", "x")], {"keep": 1, "x": 2}, {"keep": 1}), ([op("rename", "o -> n")], {"o": 1}, {"n": 1}),
    ([op("copy", "s -> d")], {"s": 42}, {"s": 42, "d": 42}), ([op("default", "p = 'n'")], {"e": 1}, {"e": 1, "p": "n"}), ([op("default", "p = 'n'")], {"p": "high"}, {"p": "high"}), ([op("default", "p = 'n'")], {"p": None}, {"p": None}),
    ([op("set", "a.b.c = 1")], {}, {"a": {"b": {"c": 1}}}), ([op("set", "a.b = 1")], {"a": 5}, {"a": 5}), ([op("rename", "x -> a.b")], {"x": 1, "a": 5}, {"a": 5}), ([op("remove", "a.b"), op("copy", "q -> r")], {"a": {"b": 1}}, {"a": {}}),
    ([Op("set", (), 1)], {"a": 1}, {"a": 1}),
]


def test_transforms_on_values_and_in_spark(spark):
    for ops, before, after in CASES:
        assert apply_ops(json.loads(json.dumps(before)), ops) == after
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (_, b, _) in enumerate(CASES)] + [(90, None), (91, "no json"), (92, "[1]")], "i int, j string")
    got = {r["i"]: r["o"] for r in df.select("i", transforms.transform_json(F.col("j"), CASES[1][0]).alias("o")).collect()}
    assert json.loads(got[1]) == {"a": 2} and got[90] is None and got[91] == "no json" and got[92] == "[1]"
    with pytest.raises(ValueError):
        op("set", "nothing")


def test_transformed_payloads_are_always_valid_json(spark):
    texts = ['{"n":12345678901234567890.123,"e":1e999,"z":1.50,"i":' + "7" * 5000 + "}", '{"n":NaN}', '{"n":Infinity}', None, "", '{"n":"\\ud800","é\\udc00":"ü"}', '{"a":1,"a":2}', "[" * 3000 + "]" * 3000, '{"n":null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    ops = [op("copy", "n -> m"), op("set", "x = 0.5")]
    got = {r["i"]: r["o"] for r in df.select("i", transforms.transform_json(F.col("j"), ops).alias("o")).collect()}
    assert got[0] == texts[0][:-1] + ',"m":12345678901234567890.123,"x":0.5}'
    assert [got[i] for i in (1, 2, 3, 4, 7)] == [texts[i] for i in (1, 2, 3, 4, 7)]
    assert json.loads(got[5]) == {"n": "\ud800", "é\udc00": "ü", "m": "\ud800", "x": 0.5} and got[6] == '{"a":2,"x":0.5}' and got[8] == '{"n":null,"m":null,"x":0.5}'
    with pytest.raises(ValueError):
        op("set", "x = 1e999")


def test_transforms_reach_the_headers(spark):
    rows = [(1, "t", '{"id": 7.0, "o": {"a": 1}}', {"k": "v"}, "mine"), (2, "t", "no json", {"k": "v"}, None), (3, "t", '{"id": 8}', None, None)]
    df = spark.createDataFrame(rows, "id int, topic string, body string, headers map<string,string>, rule string").withColumn("data", F.expr("try_parse_json(body)"))
    rules = [routing.Rule("r", "*", [routing.Target("s")], transforms=[op("copy", "payload.id -> headers.id"), op("copy", "o -> headers.o"), op("remove", "headers.k"), op("rename", "id -> headers.x.y")])]
    got = {r["id"]: (r["body"], r["headers"], r["rule"]) for r in routing.apply_rules(df, rules, VariantFields("data"), payload_json="body", headers="headers").collect()}
    assert got[1] == ('{"o":{"a":1}}', {"id": "7.0", "o": '{"a":1}', "x.y": "7.0"}, "r") and got[2] == ("no json", {"k": "v"}, "r")
    assert json.loads(got[3][0]) == {"headers": {"id": 8, "x": {"y": 8}}} and got[3][1] is None


def test_rules_meet_only_the_topics_they_match(spark):
    df = spark.createDataFrame([(i, t, f'{{"v":{i}}}') for i, t in enumerate(["a.b", "a.c", "x", None])], "id int, topic string, body string").withColumn("data", F.expr("try_parse_json(body)"))
    rules = [routing.Rule(f"r{i}", p, [routing.Target("s")], where=w) for i, (p, w) in enumerate([("a.*", "v >= 1"), (">", None), ("*.b", "v >= 1"), ("a.>", "v >= 0")])]
    out = routing.apply_rules(df, rules, VariantFields("data"))
    assert sorted((r["id"], r["rule"]) for r in out.collect()) == [(0, "r1"), (0, "r3"), (1, "r0"), (1, "r1"), (1, "r3"), (2, "r1")]
    plan = out._jdf.queryExecution().toString()
    assert "RLIKE" not in plan.upper()


def test_once_per_consumer_keeps_events_without_ids(spark):
    df = spark.createDataFrame([(None, "a.b", 1), (None, "a.b", 2), ("m", "a.b", 3), ("m", "a.b", 4), (None, "z", 5)], "msg_id string, topic string, n int")
    subs = [{"sub_id": "s1", "consumer_id": "c", "pattern": ">"}, {"sub_id": "s2", "consumer_id": "c", "pattern": "a.*", "filter": "n > 1"}, {"sub_id": "s3", "consumer_id": None, "pattern": "a.b"}, {"sub_id": "s4", "consumer_id": None, "pattern": ">", "filter": "n == 5"}]
    fields = StructFields(df.schema)
    got = sorted((r["n"], r["sub_id"]) for r in routing.deliver(df, subs, fields, once_per_consumer=True).collect())
    assert got == [(1, "s1"), (1, "s3"), (2, "s1"), (2, "s3"), (3, "s1"), (3, "s3"), (4, "s1"), (4, "s3"), (5, "s1"), (5, "s4")]
    assert routing.deliver(df, subs, fields).count() == 5 + 3 + 4 + 1


def test_replies_at_the_edges_of_spans(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    asked = spark.createDataFrame([("q0", "in", s(0)), ("q59", "in", s(59)), ("q60", "in", s(60)), ("qn", None, s(0)), ("qt", "in", None)], "msg_id string, reply_to string, at timestamp_ntz")
    told = spark.createDataFrame([("r0", "in", s(0)), ("r60", "in", s(60)), ("r119", "in", s(119)), ("r120", "in", s(120)), ("rx", "out", s(1)), ("rn", "in", None)], "msg_id string, topic string, at timestamp_ntz")
    got = sorted((r["msg_id"], r["reply_id"]) for r in routing.request_replies(asked, told, 60).collect())
    assert got == [("q0", "r0"), ("q0", "r60"), ("q59", "r119"), ("q59", "r60"), ("q60", "r119"), ("q60", "r120"), ("q60", "r60")]


def test_struct_transforms_match_dynamic_ones(spark):
    schema = "struct<a:int,o:struct<b:string>>"
    df = spark.createDataFrame([((1, ("x",)),), ((None, None),)], f"data {schema}")
    ops = [op("rename", "a -> o.c"), op("default", "o.b = 'none'"), op("set", "z.y = 1"), op("copy", "o.c -> d"), op("remove", "nothing")]
    out = df.select(transforms.StructPayload("data", df.schema["data"].dataType).apply(ops).column().alias("d")).select(F.to_json("d")).collect()
    assert json.loads(out[0][0]) == {"o": {"b": "x", "c": 1}, "z": {"y": 1}, "d": 1}
    assert json.loads(out[1][0]) == {"o": {"b": "none"}, "z": {"y": 1}}


def test_groups(spark):
    members = spark.createDataFrame([("g", m, i) for i, m in enumerate("abc")] + [(None, "x", 9)], "grp string, consumer_id string, joined int")
    events = spark.createDataFrame([(i, "g", "u_42" if i % 2 else None) for i in range(12)] + [(50, "empty", None), (51, None, "k")], "ingest_seq bigint, grp string, key string")
    turns = {r["ingest_seq"]: r["member"] for r in groups.assign(events.where("grp = 'g'"), members, "joined").collect()}
    assert [turns[i] for i in range(6)] == ["a", "b", "c", "a", "b", "c"]
    keyed = {r["ingest_seq"]: r["member"] for r in groups.assign(events, members, "joined", key=F.col("key")).collect()}
    assert len({keyed[i] for i in range(1, 12, 2)}) == 1 and [keyed[i] for i in range(0, 12, 2)] == ["a", "b", "c", "a", "b", "c"]
    assert keyed[50] is None and keyed[51] is None


def test_backoff_and_dead_letters(spark):
    rows = spark.createDataFrame([(a,) for a in (0, 1, 2, 3, 4, 10, 20)], "attempt int")
    assert [r[0] for r in rows.select(delivery.backoff_seconds(F.col("attempt"))).collect()] == [1, 1, 2, 4, 8, 60, 60]
    d = rows.select("attempt", delivery.decide(F.col("attempt"), 5).alias("c"), delivery.decide(F.col("attempt"), 5, "docs").alias("d"))
    got = {r["attempt"]: (r["c"], r["d"]) for r in d.collect()}
    assert got[3] == ("retry", "retry") and got[4] == ("dlq", "retry") and got[10] == ("dlq", "dlq")


def test_timeouts_pending_and_last_delivery_wins(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    rows = [("m1", "c", s(0), 1), ("m1", "c", s(50), 2), ("m2", "c", s(0), 1), ("m3", "c", s(0), 1), (None, "c", s(0), 1), ("m4", "c", None, 1), ("m5", "c", s(30), 1)]
    tracked = delivery.in_flight(spark.createDataFrame(rows, "msg_id string, consumer_id string, delivered_at timestamp_ntz, attempt int"))
    acks = spark.createDataFrame([("m2", "c", "done", s(5)), ("m3", "c", "rejected", s(5))], "msg_id string, consumer_id string, status string, acked_at timestamp_ntz")
    assert {r["msg_id"] for r in delivery.pending(tracked, acks).collect()} == {"m1", "m3", "m4", "m5"}
    now = F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")
    assert {r["msg_id"] for r in delivery.timed_out(tracked, acks, now, 30).collect()} == {"m3"}


def test_moving_average_and_admission(spark):
    rows = [("a", i, x) for i, x in enumerate([0, 1000, 2000, None, 3000])] + [("b", 1, 7), (None, 1, 5)]
    df = spark.createDataFrame(rows, "k string, seq bigint, x bigint")
    got = {(r["k"], r["seq"]): r["ema"] for r in folds.ema(df, ["k"], ["seq"], "x").collect()}
    assert [got["a", i] for i in range(5)] == [0, 1000, 1100, 1100, 1290] and got["b", 1] == 7 and got[None, 1] == 5
    assert folds.ema(df.limit(0), ["k"], ["seq"], "x").count() == 0
    rows = [("a", i, x, "clash") for i, x in enumerate([None, 2000, 10, 10, 10, None, 10] + [1] * 40)]
    df = spark.createDataFrame(rows, "k string, seq bigint, x bigint, ema string")
    for latching in (True, False):
        now, want = 0, []
        for _, _, x, _ in rows:
            want.append(now < 1000)
            if x is not None and (want[-1] or not latching):
                now = x if now == 0 else (now * 9 + x) // 10
        got = {r["seq"]: r["accepted"] for r in folds.admitted(df, ["k"], ["seq"], "x", 1000, latching).collect()}
        assert [got[i] for i in range(len(rows))] == want and any(want[3:]) != latching
    assert folds.admitted(df.limit(0), ["k"], ["seq"], "x").count() == 0


def test_token_bucket_and_last_ids_against_plain_loops(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.choice([None, 1000 + i * 100, 500])) for i in range(200)]
    got = {x["seq"]: x["allowed"] for x in folds.token_bucket(spark.createDataFrame(rows, "k string, seq bigint, ms bigint"), ["k"], ["seq"], "ms", 2.0, 3.0).collect()}
    state = {}
    for k, i, ms in rows:
        tokens, last = state.get(k, (3.0, None))
        if ms is not None:
            if last is not None and ms > last:
                tokens = min(3.0, tokens + (ms - last) * 2.0 / 1000)
            last = ms if last is None else max(last, ms)
        ok = tokens >= 1
        assert got[i] == ok
        state[k] = (tokens - ok, last)
    ids = [("c", i, r.choice([None, "a", "b", "c", "d", "e"])) for i in range(150)]
    new = {x["seq"]: x["is_new"] for x in folds.last_ids(spark.createDataFrame(ids, "k string, seq bigint, id string"), ["k"], ["seq"], "id", 3).collect()}
    kept: list = []
    for _, i, x in ids:
        fresh = x is None or x not in kept
        assert new[i] == fresh
        if fresh and x is not None:
            kept = (kept + [x])[-3:]


def test_ring(spark):
    names = [f"t{i}" for i in range(300)] + [None]
    t = spark.createDataFrame([(n,) for n in names], "topic string")
    own = lambda r, k=0: {x["topic"]: x["owners"] for x in ring.place(t, r, k).collect()}
    one = own(ring.HashRing(["a"]))
    assert {tuple(v) for k, v in one.items() if k} == {("a",)} and one[None] is None
    r3, r4 = ring.HashRing(["a", "b", "c"]), ring.HashRing(["a", "b", "c", "d"])
    own3, own4 = own(r3), own(r4)
    assert 0 < sum(own3[n] != own4[n] for n in names) < 150
    with_replicas, table = own(r3, 2), r3.owners(2)
    assert all(len(set(v)) == 3 for k, v in with_replicas.items() if k)
    for n in names[:-1]:
        h = ring.position(n)
        assert with_replicas[n] == next((o for p, o in table if p >= h), table[0][1])
    assert own(ring.HashRing([]))["t1"] == []
    v = r3.version
    r3.add("a")
    assert r3.version == v
    r3.apply("dead", "a")
    r3.apply("suspect", "b")
    assert r3.nodes == ["b", "c"] and r3.version == v + 1


def test_segment_ratios(spark):
    rows = [(0, 1, f"m{i}", "event_write") for i in range(5)] + [(0, 1, f"m{i}", "completion") for i in range(4)] + [(0, 1, "m0", "completion"), (0, 2, "z", "completion"), (0, 3, None, None)]
    got = {r["segment"]: (r["total_events"], r["completed_events"], r["ratio"], r["eligible"]) for r in stats.segment_stats(spark.createDataFrame(rows, "shard int, segment int, msg_id string, rec_type string"), ["shard", "segment"], active=False).collect()}
    assert got == {1: (5, 4, 0.8, True), 2: (0, 0, 0.0, False)}


def test_rules_targets_and_subscriptions(spark):
    df = spark.createDataFrame([(1, "order.new", '{"v":5}', None), (2, "order.new", '{"v":50}', "raw"), (3, None, None, None)], "id int, topic string, body string, enc string").withColumn("data", F.expr("try_parse_json(body)"))
    rules = [routing.Rule("r", "order.*", [routing.Target("a", where="payload.v > 40"), routing.Target("b", "g")], where="payload.v > 1", transforms=[op("set", "x = 1")]), routing.Rule("off", ">", [routing.Target("z")], enabled=False)]
    got = sorted((r["id"], r["service"], r["grp"], r["body"]) for r in routing.apply_rules(df, rules, VariantFields("data"), payload_json="body", encoding="enc").collect())
    assert got == [(1, "b", "g", '{"v":5,"x":1}'), (2, "a", None, '{"v":50,"x":1}'), (2, "b", "g", '{"v":50,"x":1}')]
    with pytest.raises(FilterError):
        routing.apply_rules(df, [routing.Rule("bad", ">", [routing.Target("a")], where=">>>")], VariantFields("data"))
    subs = [{"sub_id": "s1", "consumer_id": "c", "pattern": ">", "filter": ">>>"}, {"sub_id": "s2", "consumer_id": "c", "pattern": "order.>", "filter": "v > 10"}, {"sub_id": "s3", "consumer_id": "d", "pattern": "*"}]
    flat = df.withColumn("msg_id", F.col("id").cast("string"))
    assert sorted((r["id"], r["sub_id"]) for r in routing.deliver(flat, subs, VariantFields("data")).collect()) == [(1, "s1"), (2, "s1"), (2, "s2")]
    assert routing.deliver(flat, subs, VariantFields("data"), once_per_consumer=True).count() == 2
    assert routing.deliver(flat, [{**subs[0], "position": "latest", "since": 1}], StructFields(T.StructType([])), seq="id").count() == 1


def test_crc_and_messagepack():
    assert crc32c(b"") == 0 and crc32c(b"123456789") == 0xE3069283
    for v in (None, True, 0, 127, 128, 70000, 2**40, -1, -33, -(2**40), 1.5, "é" * 40, b"\x00\xff", [1, [2]], {"a": {"b": [None]}}, list(range(20)), {str(i): i for i in range(20)}):
        assert msgpack.unpack(msgpack.pack(v)) == v
    assert msgpack.to_json_value({"b": b"\x0a\xff", "n": float("nan"), 1: msgpack.Ext(1, b"")}) == {"b": "0aff", "n": None, "1": None}
    for bad in (b"", b"\xc1", b"\xa5ab", b"\x01\x02"):
        with pytest.raises(ValueError):
            msgpack.unpack(bad)


def test_log_segments(spark, tmp_path):
    ident = bytes(range(16))
    recs = [(1, ident, b"hello"), (2, ident, "c-1".encode()), (1, ident[::-1], msgpack.pack({"a": 1}))]
    assert len(wal.encode_record(*recs[0])) == 30
    root = str(tmp_path)
    wal.write_segment(root, 0, 1, recs)
    wal.write_segment(root, 0, 2, recs)
    broken = wal.write_segment(root, 1, 7, recs)
    data = bytearray(open(broken, "rb").read())
    data[32 + 30 + 8] ^= 1
    open(broken, "wb").write(data)
    assert wal.scan_segment(bytes(data)).why == "corrupt" and wal.scan_segment(b"nope" * 20).why == "header"
    assert wal.scan_segment(open(wal.write_segment(root, 0, 2, recs), "rb").read()[:-3]).why == "truncated"
    spark.dataSource.register(wal.WalSource)
    df = spark.read.format("streamroute_wal").load(root)
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["shard"], r["segment"], r["rec_type"]) for r in df.collect()) == sorted([(0, s, t) for s in (1, 2) for t in ("event_write", "completion", "event_write")] + [(1, 7, "event_write")])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wal").load(root)
    key = lambda rows: sorted((r["shard"], r["segment"], r["wal_offset"], bytes(r["payload"] or b"")) for r in rows)
    assert key(wal.read_wal_files(files).collect()) == key(df.collect())
    assert spark.read.format("streamroute_wal").load(f"file://{root}").count() == df.count() and spark.read.format("streamroute_wal").load(f"{root}/none").count() == 0
    assert wal.payload_json(recs[2][2]) == '{"a": 1}' and wal.payload_json(b"\xc1") is None


def test_frames():
    good = wal.encode_frame(3, 0xFF, bytes(16), b"xyz")
    assert len(wal.encode_frame(7, 0, bytes(16), b"")) == 29
    assert [(f[1], f[2], f[4], f[5]) for f in wal.scan_frames(good + good[:20])] == [("pub", 15, b"xyz", "")]
    assert [f[5] for f in wal.scan_frames(good + b"XX" + good[2:])] == ["", "4000"]
    assert [f[5] for f in wal.scan_frames(good[:-1] + b"\x00")] == ["4001"]
    assert [f[5] for f in wal.scan_frames(good, max_payload=2)] == ["4090"]


def test_gateway_bodies(spark):
    texts = ['{"topic":"t","data":1,"headers":{"a":"b","n":null}}', '{"events":[{"topic":"t","data":{}},{"data":2}]}', "x", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id bigint, body string")
    got = sorted((r["request_id"], -1 if r["event_no"] is None else r["event_no"], r["status"]) for r in gateway.publishes(df).collect())
    assert got == [(0, 0, "stored"), (1, 0, "stored"), (1, 1, "error 4000"), (2, -1, "error 4000"), (3, -1, "error 4000"), (4, -1, "error 4000")]


def test_control_files(spark):
    from streamroute.sources import config

    text = """
routes:
  - name: big
    match: {topic: "order.*", where: "payload.v > 1"}
    transform: [{set: "payload.x = 'y'"}, {rename: "a -> b"}]
    deliver: [{service: s, where: "v > 2"}, {group: g}]
  - {name: paused, enabled: false, match: {topic: ">"}, deliver: []}
"""
    got = config.rules(text)
    assert [(r.name, r.pattern, r.where, r.enabled, len(r.transforms)) for r in got] == [("big", "order.*", "payload.v > 1", True, 2), ("paused", ">", None, False, 0)]
    assert [(t.service, t.group, t.where) for t in got[0].deliver] == [("s", None, "v > 2"), ("g", "g", None)]
    acl = config.grants(spark, "namespaces: [{name: n, services: [{name: s, publish: ['a.*'], subscribe: ['>']}]}]")
    assert {tuple(r) for r in acl.collect()} == {("n", "s", "publish", "a.*"), ("n", "s", "subscribe", ">")}
    s = config.settings("delivery: {ack_timeout_secs: 7, backoff: {initial_secs: 3}}")
    assert s.ack_timeout_secs == 7 and s.backoff_initial_secs == 3 and s.max_redeliveries == 5
    assert config.settings("") == config.Settings()


def test_membership(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    rows = [("a", 1, "alive", s(58)), ("b", 1, "alive", s(40)), ("c", 1, "alive", s(0)), ("d", 2, "dead", s(10)), ("d", 1, "alive", s(59)), ("e", 1, "suspect", s(59)), (None, 1, "alive", s(1))]
    got = stats.membership(spark.createDataFrame(rows, "member string, incarnation int, state string, at timestamp_ntz"), F.lit("2024-01-01 00:01:00").cast("timestamp_ntz"))
    assert {tuple(r) for r in got.collect()} == {("a", "alive"), ("b", "suspect"), ("c", "dead"), ("d", "dead"), ("e", "suspect")}
