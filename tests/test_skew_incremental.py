import datetime as dt
import random

from pyspark.sql import functions as F

from streamroute import session
from streamroute.operators import incremental, numbering, skew


def test_heavy_keys_with_nulls_empty_names_and_ties(spark):
    rows = [("a", "hot")] * 60 + [("a", None)] * 20 + [("a", "")] * 15 + [("a", "edge")] * 5 + [("b", "x")]
    df = spark.createDataFrame(rows, "scope string, key string")
    got = {(r["scope"], r["key"], r["n_rows"]) for r in skew.heavy_keys(df, "scope", "key", 0.05).collect()}
    assert got == {("a", "hot", 60), ("a", "edge", 5), ("b", "x", 1)}
    assert skew.heavy_keys(df.limit(0), "scope", "key", 0.05).count() == 0


def test_per_key_results_equal_plain_ones(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", None, f"k{r.randrange(50)}"]), r.choice([None, r.randrange(9)])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {x["k"]: x["n"] for x in skew.distinct_per_key(df, ["k"], F.col("v"), "n").collect()}
    assert got == {k: len({v for q, v in rows if q == k and v is not None}) for k in {k for k, _ in rows}}
    pct = {x["k"]: (x["p50"], x["p99"]) for x in skew.index_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for k, (p50, p99) in pct.items():
        vs = sorted(v for q, v in rows if q == k and v is not None)
        assert (p50, p99) == (vs[int(len(vs) * 0.5)], vs[min(len(vs) - 1, int(len(vs) * 0.99))])


def test_numbers_over_blocks(spark):
    r = random.Random(4)
    seqs = r.sample(range(5000), 800)
    rows = [(s, r.choice(["hot", "hot", None, "x"])) for s in seqs]
    got = {x["seq"]: x["rn"] for x in numbering.number_rows(spark.createDataFrame(rows, "seq bigint, k string"), ["k"], "seq", block=100).collect()}
    for key in ("hot", None, "x"):
        mine = sorted(s for s, k in rows if k == key)
        assert [got[s] for s in mine] == list(range(1, len(mine) + 1))


def test_join_beyond_the_broadcast_bound_is_the_same(spark):
    big = spark.range(500).withColumn("k", F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 20).cast("int"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(0, 20, 2)], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = session.join_small(big, small, ["k"], how)
        b = session.join_small(big, small, ["k"], how, max_rows=3, salts=4)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_side_beyond_the_bound_is_never_broadcast_by_its_files_size(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 100).alias("k")).write.parquet(str(tmp_path / "big"))
    spark.range(100).select(F.col("id").alias("k"), F.lit(10).alias("n")).write.parquet(str(tmp_path / "small"))
    big, small = spark.read.parquet(str(tmp_path / "big")), spark.read.parquet(str(tmp_path / "small"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        for out in (session.join_small(big, small, ["k"], how, max_rows=3), session.join_counted(big, small, ["k"], "n", how, max_rows=3)):
            # of hot keys the join may broadcast the names
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert out.count() == (0 if how == "left_anti" else 1000) and "strategy=merge" in plan
            if "__hot" not in plan:
                assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_counted_join_copies_hot_keys_only(spark, monkeypatch):
    key = F.when(F.col("id") < 300, 7).when(F.col("id") > 400, F.col("id") % 20).cast("int")
    big = spark.range(500).withColumn("k", key)
    small = big.where("k % 2 = 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("v"), F.max("k")).alias("v"))
    plain, copies, broadcast, explode = small.drop("n"), [], session.F.broadcast, session.F.explode
    monkeypatch.setattr(session.F, "broadcast", lambda df: copies.append(df) or broadcast(df))
    monkeypatch.setattr(session.F, "explode", lambda c: copies.append(c) or explode(c))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = big.join(plain, ["k"], how), session.join_counted(big, small, ["k"], "n", how, max_rows=3, hot_rows=100, salts=4)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    hot, lanes = copies[-2:]  # the driver gets the hot key, and only it is copied
    assert [r["k"] for r in hot.collect()] == [7]
    assert small.join(hot, "k", "left").select(F.sum(F.size(lanes))).first()[0] == small.count() + 3


MARKS = "mark_id bigint, run_no int, follower_id string, shard int, last_segment int, last_offset bigint, status string, confirmed_at timestamp_ntz"
RECORDS = "shard int, segment int, wal_offset bigint, rec_len int, rec_type string, msg_id string, consumer_id string, payload string, crc_ok boolean, revision int, scan_no int, written_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def make(seed: int):
    r = random.Random(seed)
    at = lambda: r.choice([None, *[T0 + dt.timedelta(minutes=r.randrange(100)) for _ in range(5)]])
    recs = []
    for _ in range(400):
        recs.append((r.choice([0, 0, 0, 1, 2, None]), r.choice([3, 5, 6]), r.choice([r.randrange(30), None]), 30, r.choice(["event_write", None]), r.choice(["m", None]), None, "p", r.choice([True, False, None]), r.choice([0, 0, 1, None]), r.choice([1, 2]), at()))
    marks = [
        (i, r.choice([1, 2, 3]), r.choice(["f1", "f2", "f3"]), r.choice([0, 1]), r.choice([3, 5, None]), r.choice([r.randrange(30), None]), r.choice(["ok", "ok", "failed", None]), T0 + dt.timedelta(minutes=r.randrange(100)))
        for i in range(25)
    ]
    return recs + recs[:40], marks


def brute(recs, marks):
    followers = {m[2] for m in marks if m[2] is not None}
    out = set()
    for f in followers:
        for shard in {x[0] for x in recs if x[0] is not None}:
            ok = [m for m in marks if m[2] == f and m[3] == shard and m[6] == "ok" and m[4] is not None and m[5] is not None]
            last = max(ok, key=lambda m: (m[1], m[4], m[5], m[7])) if ok else None
            for x in recs:
                if x[0] != shard or x[1] is None or x[2] is None:
                    continue
                after = last is None or (x[1], x[2]) > (last[4], last[5])
                fixed = last is not None and (x[9] or 0) > 0 and x[11] is not None and x[11] > last[7]
                if after or fixed:
                    out.add((f, shard, x[1], x[2]))
    return out


def test_records_since_the_last_successful_run(spark):
    for seed in (1, 2):
        recs, marks = make(seed)
        got = incremental.records_since(spark.createDataFrame(recs, RECORDS).repartition(3), spark.createDataFrame(marks, MARKS)).collect()
        assert len(got) == len(set(map(tuple, got)))
        assert {tuple(r) for r in got} == brute(recs, marks)


def test_records_without_reports_and_empty_tables(spark):
    recs, marks = make(3)
    none = spark.createDataFrame([], MARKS)
    assert incremental.records_since(spark.createDataFrame(recs, RECORDS), none).count() == 0  # no follower, no case
    failed = [(1, 1, "f", 0, 3, 3, "failed", T0)]
    got = incremental.records_since(spark.createDataFrame(recs, RECORDS), spark.createDataFrame(failed, MARKS))
    assert {tuple(r) for r in got.collect()} == brute(recs, failed)
    assert incremental.records_since(spark.createDataFrame([], RECORDS), spark.createDataFrame(marks, MARKS)).count() == 0


def test_only_changed_partitions_are_recomputed_and_replaced(spark, tmp_path):
    t = incremental.IncrementalTable(spark, f"file://{tmp_path}/t", ["part"], ["part", "id", "v"], lambda df: df.select("id", (F.col("v") * 2).alias("w"), "part"))
    rows = [(p, i, i * p) for p in range(1, 5) for i in range(10)]
    mk = lambda rs: spark.createDataFrame(rs, "part int, id int, v int")
    assert {r["part"] for r in t.refresh(mk(rows)).collect()} == {1, 2, 3, 4}
    assert t.refresh(mk(rows)).count() == 0
    changed = [r for r in rows if r[0] != 4] + [(2, 99, 1), (7, 0, 5)]
    assert {r["part"] for r in t.refresh(mk(changed[::-1])).collect()} == {2, 7}
    want = sorted((p, i, v * 2) for p, i, v in changed)
    assert sorted((r["part"], r["id"], r["w"]) for r in t.read().collect()) == want


def test_a_run_that_dies_before_its_commit_is_repeated(spark, tmp_path):
    class Dies(Exception):
        pass

    def broken(df):
        raise Dies

    path = f"file://{tmp_path}/t"
    mk = lambda n: spark.createDataFrame([(1, i) for i in range(n)] + [(2, 0)], "part int, v int")
    good = incremental.IncrementalTable(spark, path, ["part"], ["part", "v"])
    good.refresh(mk(3))
    try:
        incremental.IncrementalTable(spark, path, ["part"], ["part", "v"], broken).refresh(mk(5))
    except Dies:
        pass
    assert {r["part"] for r in good.refresh(mk(5)).collect()} == {1}
    assert good.read().count() == 6


def test_fingerprints_dont_depend_on_order_and_see_swapped_nulls_and_parts(spark):
    mk = lambda rs: spark.createDataFrame(rs, "p int, a string, b string")
    f = lambda df: tuple(incremental.fingerprints(df, ["p"], incremental.row_hash(["a", "b"])).collect()[0])
    a, b = [(1, None, "2"), (1, "3", "4")], [(1, "3", "4"), (1, None, "2")]
    assert f(mk(a)) == f(mk(b)) != f(mk([(1, "2", None), (1, "3", "4")]))
    assert f(mk([(1, "x", "yz")])) != f(mk([(1, "xy", "z")])) and f(mk([(1, "", None)])) != f(mk([(1, None, "")]))


def positive(df):
    return df.where("v > 0").select("part", "v")


def values(t):
    return sorted((r["part"], r["v"]) for r in t.read().collect())


def test_a_partition_that_becomes_empty_loses_its_rows(spark, tmp_path):
    mk = lambda rs: spark.createDataFrame(rs, "part int, v int")
    t = incremental.IncrementalTable(spark, f"file://{tmp_path}/t", ["part"], ["part", "v"], positive)
    t.refresh(mk([(1, 5), (2, 7)]))
    assert values(t) == [(1, 5), (2, 7)]
    assert [r["part"] for r in t.refresh(mk([(1, -5), (2, 7)])).collect()] == [1]
    assert values(t) == [(2, 7)]
    t.refresh(mk([(1, -5)]))
    assert values(t) == []


def test_a_run_that_dies_between_data_and_commit_is_undone_though_the_source_went_back(spark, tmp_path):
    class Dies(Exception):
        pass

    mk = lambda rs: spark.createDataFrame(rs, "part int, v int")
    t = incremental.IncrementalTable(spark, f"file://{tmp_path}/t", ["part"], ["part", "v"], positive)
    t.refresh(mk([(1, 5), (2, 7)]))

    def no_commit(prints, v):
        raise Dies

    broken = incremental.IncrementalTable(spark, f"file://{tmp_path}/t", ["part"], ["part", "v"], positive)
    broken._commit = no_commit
    for rows in ([(1, 6), (2, 7)], [(1, 6), (2, 8)]):
        try:
            broken.refresh(mk(rows))
        except Dies:
            pass
    assert sorted(r["part"] for r in t.refresh(mk([(1, 5), (2, 7)])).collect()) == [1, 2]
    assert values(t) == [(1, 5), (2, 7)]
    assert t.refresh(mk([(1, 5), (2, 7)])).count() == 0


def test_rows_that_arrive_during_a_run_are_the_next_ones(spark, tmp_path):
    source = f"file://{tmp_path}/s"
    mk = lambda rs: spark.createDataFrame(rs, "part int, v int")
    mk([(1, 5), (2, 7)]).write.parquet(source)
    late = iter([[(1, 6)], [], []])

    def derive(df):
        if rows := next(late):
            mk(rows).write.mode("append").parquet(source)
        return positive(df)

    t = incremental.IncrementalTable(spark, f"file://{tmp_path}/t", ["part"], ["part", "v"], derive)
    t.refresh(spark.read.parquet(source))
    assert [r["part"] for r in t.refresh(spark.read.parquet(source)).collect()] == [1]
    assert values(t) == [(1, 5), (1, 6), (2, 7)]


def test_null_and_empty_partition_keys_and_clashing_names(spark, tmp_path):
    mk = lambda rs: spark.createDataFrame(rs, "part string, v int, n int, fp_rows string")
    t = incremental.IncrementalTable(spark, f"file://{tmp_path}/t", ["part"], ["part", "v"])
    rows = [(None, 1, 1, "x"), ("", 2, 2, None), ("a/b=c", 3, 3, "y"), ("A/b=c", 4, 4, "y")]
    t.refresh(mk(rows))
    assert sorted(map(str, t.read().collect())) == sorted(map(str, mk(rows).collect()))
    assert [r["part"] for r in t.refresh(mk([(None, 9, 1, "x"), *rows[1:]])).collect()] == [None]
    assert t.refresh(mk(rows).limit(0)).count() == 0 and t.read().count() == 0


def test_a_change_of_content_without_a_revision_and_a_followers_progress_are_seen(spark, tmp_path):
    rec = lambda off, payload: (0, 3, off, 30, "event_write", "m", None, payload, True, 0, 1, T0)
    mark = lambda off, run: (run, run, "f", 0, 3, off, "ok", T0)
    path = f"file://{tmp_path}/t"

    def again(recs, marks):
        t, pairs = incremental.take_over_table(spark.createDataFrame(recs, RECORDS), spark.createDataFrame(marks, MARKS), path)
        return t.refresh(pairs).count(), sorted(r["wal_offset"] for r in t.read().collect())

    recs = [rec(i, "p") for i in range(4)]
    assert again(recs, [mark(1, 1)]) == (1, [2, 3])
    assert again(recs, [mark(1, 1)]) == (0, [2, 3])
    assert again([rec(0, "other"), *recs[1:]], [mark(1, 1)]) == (1, [2, 3])
    assert again([rec(0, "other"), *recs[1:]], [mark(1, 1), mark(3, 2)]) == (1, [])
