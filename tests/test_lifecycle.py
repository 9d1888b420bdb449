import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamroute import session
from streamroute.operators import access, dedup, delivery, folds, groups, numbering, ring, stats
from streamroute.operators.bloom import Bloom
from streamroute.sources import crc32c, wal
from streamroute.streaming import pipeline as st

T0 = dt.datetime(2024, 1, 1)


def test_bloom_sizes_counts_and_rate():
    b = Bloom(10_000, 0.01)
    assert (b.m, b.k) == (95851, 7) and Bloom().m == 14377588 and Bloom().k == 10
    rng = np.random.default_rng(1)
    keys, others = np.unique(rng.integers(0, 2**63, 10_000).astype(np.uint64)), rng.integers(0, 2**63, 100_000).astype(np.uint64)
    b.insert(keys)
    b.insert(keys[:10])
    assert b.may_contain(keys).all() and b.count == len(keys) + 10 and b.may_contain(others).mean() < 0.013
    b.clear()
    assert b.count == 0 and not b.may_contain(keys).any()


def messages(n, seed):
    r = random.Random(seed)
    keys = [r.choice([None, "hot", "hot", f"k{r.randrange(200)}"]) for _ in range(n)]
    return [(i * 2, k, r.choice([None, 1, 2, 3]), "clash") for i, k in enumerate(keys)] + [(None, "k1", 1, "clash")]


SCHEMA = "seq bigint, id string, batch int, status string"


@pytest.mark.parametrize("rate", [0.001, 0.5])
def test_tiers_against_a_set(spark, rate):
    rows = messages(1500, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    seen, want = set(), {}
    for s, k, *_ in rows:
        if s is not None:
            want[s] = "duplicate" if k in seen else "stored"
            seen |= {k} - {None}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # within one Arrow batch answers are exact
    for mode in dedup.MODES:
        got = {r["seq"]: r["status"] for r in dedup.tiered(df, F.col("id"), "seq", mode, capacity=150, rate=rate).collect()}
        assert len(got) == len(rows) and got.pop(None) == "stored"
        if mode == "durable" or rate < 0.01:
            assert got == want
        else:  # what the filter takes for seen is lost, nothing seen is stored
            lost = sum(got[s] != w for s, w in want.items())
            assert 0 < lost < 200 and all(got[s] == "duplicate" for s, w in want.items() if w == "duplicate")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert dedup.tiered(df.limit(0), F.col("id"), "seq").count() == 0
    with pytest.raises(ValueError):
        dedup.tiered(df, F.col("id"), "seq", "other")


def test_copies_within_a_keys_first_batch_are_all_stored(spark):
    rows = [(1, "a", 1, ""), (2, "a", 1, ""), (3, "a", 2, ""), (4, None, 2, ""), (5, None, 3, ""), (6, "b", None, ""), (7, "b", 5, ""), (8, "b", 5, ""), (9, "b", 6, "")]
    got = {r["seq"]: r["status"] for r in dedup.checks_before_inserts(spark.createDataFrame(rows, SCHEMA), F.col("id"), "batch").collect()}
    assert {s for s, x in got.items() if x == "duplicate"} == {3, 9} and len(got) == 9


def test_many_repeated_ids_do_not_pass_through_the_driver(spark, monkeypatch):
    n, sizes, broadcast = 25_000, [], session.F.broadcast
    monkeypatch.setattr(session.F, "broadcast", lambda df: sizes.append(df.count()) or broadcast(df))
    df = spark.range(2 * n).select(F.col("id").alias("seq"), (F.col("id") % n).cast("string").alias("id"), F.floor(F.col("id") / n).alias("batch"))
    got = dedup.checks_before_inserts(df, F.col("id"), "batch").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    assert {tuple(r) for r in got.collect()} == {("stored", n, 0), ("duplicate", n, n)}
    assert all(size <= 20_000 for size in sizes)


def test_ids_kept_only_after_success(spark):
    rows = [("c", i, k, ok) for i, (k, ok) in enumerate([("a", False), ("a", True), ("a", True), ("b", None), ("b", False), ("b", True), ("b", False), (None, True), (None, True)])]
    df = spark.createDataFrame(rows, "k string, seq bigint, id string, ok boolean")
    new = lambda **o: [r["is_new"] for r in folds.last_ids(df, ["k"], ["seq"], "id", **o).orderBy("seq").collect()]
    assert new() == [True, False, False, True, False, False, False, True, True]
    assert new(handled="ok") == [True, True, False, True, True, True, False, True, True]


def test_redeliveries_with_overrides(spark):
    rows = [("m", "a.b", 1, T0), ("m", "a.b", 2, T0), ("m", "x", 3, T0), ("m", "x", 4, None), ("m", None, 9, T0), ("m", "a.c", 1, T0)]
    df = spark.createDataFrame(rows, "msg_id string, topic string, attempt int, failed_at timestamp_ntz")
    over = spark.createDataFrame([("a.>", 9), ("a.b", 3), (None, 1)], "pattern string, most int")
    got = sorted((str(r["topic"]), r["attempt"], r["decision"], r["next_attempt"], r["due_at"]) for r in delivery.redeliveries(df, over).collect())
    s = lambda n: T0 + dt.timedelta(seconds=n)
    assert got == [("None", 9, "dlq", None, None), ("a.b", 1, "retry", 2, s(2)), ("a.b", 2, "dlq", None, None), ("a.c", 1, "retry", 2, s(2)), ("x", 3, "retry", 4, s(8)), ("x", 4, "dlq", None, None)]
    assert delivery.redeliveries(df, over.limit(0)).count() == len(rows)


def test_counters_never_fall_below_none(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), i, r.choice([1, -1, -1, None])) for i in range(300)] + [("a", None, 1)]
    got = {x["k"]: x["n"] for x in stats.saturating_counts(spark.createDataFrame(rows, "k string, seq bigint, d int"), ["k"], "seq", F.col("d"), block=16).collect()}
    want: dict = {}
    for k, i, d in rows[:-1]:
        want[k] = max(0, want.get(k, 0) + (d or 0))
    assert got == want


def test_histograms_and_their_quantiles(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 30.0)] + [("b", 500.0), ("a", None), ("c", None)]
    h = stats.histogram(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [2.0, 10.0])
    assert sorted((r["k"], r["le"], r["n"]) for r in h.collect()) == [("a", 2.0, 2), ("a", 10.0, 3), ("a", float("inf"), 4), ("b", 2.0, 0), ("b", 10.0, 0), ("b", float("inf"), 1)]
    q = lambda x: {r["k"]: r["quantile"] for r in stats.histogram_quantile(h, ["k"], x).collect()}
    assert q(0.25) == {"a": 1.0, "b": 10.0} and q(0.625)["a"] == 6.0 and q(0.99)["a"] == 10.0


def test_higher_priorities_go_first(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "hot", None]), r.choice([None, 0, 2, 5])) for i in range(400)]
    got = {x["seq"]: x["rn"] for x in numbering.by_priority(spark.createDataFrame(rows, "seq bigint, k string, p int"), ["k"], "p", "seq", block=50).collect()}
    for k in ("hot", None):
        mine = sorted((x for x in rows if x[1] == k), key=lambda x: (-(x[2] if x[2] is not None else -1), x[0]))
        assert [got[s] for s, *_ in mine] == list(range(1, len(mine) + 1))


def test_logs_of_members_and_nodes(spark):
    log = spark.createDataFrame([("g", "a", "add", 1), ("g", "a", "remove", 2), ("g", "b", "remove", 1), ("g", "b", "add", 3), (None, "c", "add", 1), ("g", None, "add", 1)], "grp string, consumer_id string, op string, at int")
    assert [tuple(r) for r in groups.members_after(log, "at").collect()] == [("g", "b", 3)]
    events = spark.createDataFrame([("n", "dead", 0), ("n", "joined", 1), ("n", "joined", 2), ("n", "suspect", 3), ("n", "dead", 4), ("n", "recovered", 5), (None, "joined", 1), ("m", "suspect", 1)], "node string, event string, at int")
    assert [tuple(r) for r in ring.nodes_after(events, "at").collect()] == [("n", True, 3)]


def test_codes_of_refused_requests(spark):
    reg = spark.createDataFrame([("n", "s", "k"), ("n", "s", "k2"), ("n", None, "k"), (None, "s", "k")], "ns string, service_id string, api_key string")
    rows = [(1, "n", "s", "k"), (2, "n", "s", "k2"), (3, "n", "s", None), (4, "n", "t", "k"), (5, "x", "s", "k"), (6, None, "s", "k"), (7, "n", None, "k")]
    df = spark.createDataFrame(rows, "i int, ns string, service_id string, api_key string")
    assert [r["code"] for r in access.authenticate(df, reg).orderBy("i").collect()] == [None, None, 4010, 4010, 4040, 4040, 4010]
    assert access.authenticate(df, reg, anonymous=True).where("code is not null").count() == 0
    reqs = spark.createDataFrame([(1, "s", "a.b", 5, None), (2, "s", "z", 5, None), (3, "s", "", 5, None), (4, "s", None, 5, None), (5, "s", "a.b", 50, None), (6, "s", "a.b", None, 4010)], "i int, svc string, topic string, size int, code int")
    acl = spark.createDataFrame([("s", "a.>")], "svc string, pattern string")
    assert [r["code"] for r in access.refused(reqs, acl, ["svc"], "size", 10).orderBy("i").collect()] == [None, 4030, 4000, 4000, 4090, 4010]


def test_rates_and_load(spark):
    rows = [("a", T0 + dt.timedelta(seconds=60 * i), i, i % 4 != 0) for i in range(10)] + [("a", None, 5, None)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, x int, ok boolean")
    got = {r["window_end"]: r["n"] for r in stats.sliding_rate(df, "at", ["k"]).collect()}
    assert got[T0 + dt.timedelta(minutes=5)] == 5 and got[T0 + dt.timedelta(minutes=1)] == 1 and sum(got.values()) == 50
    r = stats.load_test(df, ["k"], F.col("ok"), "x", "at").collect()[0]
    assert (r["n"], r["n_ok"], r["n_error"], r["least"], r["most"]) == (11, 7, 4, 1, 9) and abs(r["per_second"] - 11 / 540) < 1e-12
    assert [x["line"] for x in stats.metrics_text(spark.createDataFrame([('q"\\\n', None, 3)], "a string, b string, n int"), "m", ["a", "b"], "n").collect()] == ['m{a="q\\"\\\\\\n"} 3']


def test_batches_flush_when_full_or_late(spark):
    times = [0, 1, 2, 3, 100, None, 104, 106, 106, 50]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)] + [(None, 0, None)], "k string, seq bigint, ms bigint")
    got = {(r["k"], r["seq"]): r["batch"] for r in folds.micro_batches(df, ["k"], ["seq"], "ms", 3, 5).collect()}
    assert [got["k", i] for i in range(len(times))] == [0, 0, 0, 1, 2, 2, 2, 3, 3, 3] and got[None, 0] == 0
    assert folds.micro_batches(df.limit(0), ["k"], ["seq"], "ms").count() == 0


def test_long_records_have_the_same_checksum():
    r = random.Random(5)
    blocks = [r.randbytes(n) for n in (0, 1, 9, 2047, 2048, 2049, 30_001)]

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (crc32c.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert [crc32c.crc32c(b) for b in blocks] == crc32c.crc32c_many(blocks).tolist() == [plain(b) for b in blocks]
    assert crc32c.crc32c(blocks[-1][100:], crc32c.crc32c(blocks[-1][:100])) == plain(blocks[-1]) and crc32c.crc32c_many([]).tolist() == []


def test_a_written_log_rotates_and_reads_back(spark, tmp_path):
    rows = [(i % 2, i, "event_write" if i % 5 else "completion", f"{i:032x}", bytes([i % 256]) * (i % 90)) for i in range(200)] + [(None, 1, "event_write", "00" * 16, b""), (0, 1, "event_write", None, b"")]
    log = wal.write_log(spark.createDataFrame(rows, "shard int, seq int, rec_type string, msg_id string, data binary").repartition(3), f"file://{tmp_path}/log", segment_bytes=2000)
    for _ in range(2):  # a repeated task writes the same segments
        parts = log.collect()
        assert len(parts) > 4 and all(p["n_bytes"] <= 2000 for p in parts) and sum(p["n_records"] for p in parts) == 200
    spark.dataSource.register(wal.WalSource)
    got = spark.read.format("streamroute_wal").load(f"file://{tmp_path}/log").collect()
    back = sorted((r["shard"], r["segment"], r["wal_offset"], r["msg_id"]) for r in got)
    assert [(s, m) for s, *_, m in back] == [(s, m) for s, _, _, m, _ in sorted(rows[:200], key=lambda x: (x[0], x[1]))]


def test_frames_of_captured_streams(spark):
    rows = [("a", 2, "ack", 3, "00" * 16, b"x"), ("a", 1, "pub", 20, "01" * 16, b"yy"), ("b", 1, "ping", 0, "02" * 16, b""), (None, 1, "ping", 0, "02" * 16, b""), ("b", 2, "ping", 0, None, b"")]
    caps = wal.frames_of(spark.createDataFrame(rows, "conn string, n int, frame_type string, flags int, msg_id string, payload binary"), F.col("conn"), "n")
    got = [(r["name"], r["frame_type"], r["flags"], bytes(r["payload"]), r["code"]) for r in wal.read_frames(caps).orderBy("name", "frame_offset").collect()]
    assert got == [("a", "pub", 4, b"yy", ""), ("a", "ack", 3, b"x", ""), ("b", "ping", 0, b"", "")]
    assert [r["code"] for r in wal.read_frames(caps.where("name = 'a'"), 1).collect()] == ["4090"]
    df = spark.createDataFrame([('{"a":[1,2.5,null,true,"é"]}',), ("no",), (None,), ('{"n":99999999999999999999999}',)], "j string")
    assert [r[0] for r in df.select(wal.unpacked(wal.packed(F.col("j")))).collect()] == ['{"a": [1, 2.5, null, true, "é"]}', None, None, None]


def test_streams_that_wrote_nothing_and_complete_results(spark, tmp_path):
    schema = "k string, v bigint"
    for i, rows in enumerate([[("a", 1)], [("a", 2), ("b", 3)], [("b", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    total = st.run_available(stream().groupBy("k").agg(F.sum("v").alias("v")), "complete")
    assert sorted(map(tuple, total.collect())) == [("a", 3), ("b", 7)]
    assert st.run_available(stream().where("k = 'none'")).count() == 0
    first = st.keep_first_available(stream(), [F.col("k")], [F.col("v")], ["key"])
    assert sorted((r["k"], r["v"]) for r in first.collect()) == [("a", 1), ("b", 3)]


def test_sides_too_many_or_too_large_arent_broadcast(spark):
    small = spark.createDataFrame([(1, "x" * 1000), (2, None)], "k int, v string")
    assert session._small_enough(small, 2) and not session._small_enough(small, 1)
    session.BROADCAST_BYTES, kept = 500, session.BROADCAST_BYTES
    try:
        assert not session._small_enough(small, 2)
    finally:
        session.BROADCAST_BYTES = kept
