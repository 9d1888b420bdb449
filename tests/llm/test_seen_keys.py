import random

import numpy as np
from pyspark.sql import functions as F

from streamroute.llm import seen_keys as sk


def rows_of(n: int, seed: int):
    r = random.Random(seed)
    out, keys = [], []
    for i in range(n):
        k = r.choice([None, "hot", "hot", "hot", r.choice(keys) if keys else "x", f"k{i}", f"k{i}", f"k{i}"])
        keys.append(k or "y")
        out.append((i * 3, k, "clash", False))
    return out


def brute(rows, past):
    seen, out = set(p for p in past if p is not None), set()
    for seq, k, *_ in sorted(rows):
        if k is None:
            continue
        if k in seen:
            out.add(seq)
        seen.add(k)
    return out


SCHEMA = "ingest_seq bigint, id string, h string, seen boolean"


def test_against_a_set(spark):
    rows, past = rows_of(4000, 1), [None, "k3", "k3", "k777", "never"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    old = spark.createDataFrame([(p,) for p in past], "e string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        a = sk.seen_before(df, F.col("id"), "ingest_seq", old, F.col("e"), 1e-7)
        got = {r["ingest_seq"]: r["seen"] for r in a.where("kind = 'row'").collect()}
        rate = sk.error_rate(a, 1e-7).collect()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    assert {s for s, seen in got.items() if seen} == brute(rows, past)
    assert rate["n_missed"] == 0 and rate["n_false"] == 0 and rate["n_probes"] > 0


def test_without_history_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", None, None)] * 5 + [(2, None, None, None), (None, "a", None, None)], SCHEMA)
    got = sk.seen_before(df, F.col("id"), "ingest_seq").where("kind = 'row'").collect()
    assert [r["seen"] for r in got if r["ingest_seq"] is None] == [False]
    assert sorted((r["ingest_seq"], r["seen"]) for r in got if r["ingest_seq"] is not None) == [(1, False)] + [(1, True)] * 4 + [(2, False)]
    none = sk.seen_before(df.limit(0), F.col("id"), "ingest_seq")
    assert none.count() == 0
    assert sk.error_rate(none, 0.1).collect()[0]["measured_rate"] is None


def test_filters_are_saved_and_grow_over_batches(spark, tmp_path):
    rows = rows_of(6000, 5)
    want = brute(rows, [])
    store = sk.SeenFilters(spark, f"file://{tmp_path}/f", 1e-6)
    mk = lambda rs: spark.createDataFrame(rs, SCHEMA).repartition(3)
    take = lambda i: {r["seq"] for r in store.take(i, mk(rows[cuts[i] : cuts[i + 1]]), F.col("id"), F.col("ingest_seq")).where("kind = 'row' and seen").collect()}
    cuts = [0, 3, 2500, 6000]
    got = [take(i) for i in range(3)]
    assert set().union(*got) == want
    assert take(1) == got[1]  # a batch that is repeated starts from the filters of the one before it
    assert store.state().where("n_keys > 0").count() >= store.state().select("part").distinct().count() > 0
    assert store.state(1).agg(F.sum("n_keys")).first()[0] <= 3


def test_full_layers_are_followed_by_larger_ones_within_the_target():
    rng = np.random.default_rng(2)
    layers = sk.Layers(1000, 0.01)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    for part in np.array_split(keys, 40):
        layers.insert(part)
    assert len(layers.filters) > 3 and sum(layers.counts) == len(keys) and layers.query(keys).all()
    assert layers.false_yes(100_000, 3) < 0.0125 * 100_000
    again = sk.Layers(1000, 0.01)
    for i, (f, n) in enumerate(zip(layers.filters, layers.counts)):
        again.load(i, n, f.words.tobytes())
    assert again.query(keys).all() and again.false_yes(100_000, 3) == layers.false_yes(100_000, 3)


def test_filters_of_one_size_merge():
    a, b = sk.BlockedBloom(1000, 0.01), sk.BlockedBloom(1000, 0.01)
    x, y = np.arange(0, 500, dtype=np.uint64), np.arange(500, 1000, dtype=np.uint64)
    a.insert(x)
    b.insert(y)
    a.merge(b)
    assert a.query(np.concatenate([x, y])).all()
    try:
        a.merge(sk.BlockedBloom(9, 0.01))
        raise AssertionError
    except ValueError:
        pass


def test_the_upper_bound_of_a_rate():
    assert abs(sk.poisson_upper(0) - 2.9957) < 1e-3 and abs(sk.poisson_upper(3) - 7.7537) < 1e-3


def test_measured_rate_keeps_to_the_target():
    rng = np.random.default_rng(1)
    for target in (0.05, 0.01, 0.001):
        b = sk.BlockedBloom(50_000, target)
        keys = rng.integers(0, 2**63, 50_000).astype(np.uint64)
        b.insert(keys)
        assert b.query(keys).all()
        rate = b.query(sk.absent_twin(rng.integers(0, 2**63, 200_000).astype(np.uint64))).mean()
        assert rate < 1.25 * target + 1e-4
        assert b.words.nbytes < 50_000 * 8


def test_sizing_takes_more_bits_for_rarer_errors():
    sizes = [sk.sizing(t)[0] for t in (0.1, 0.01, 1e-4, 1e-7)]
    assert sizes == sorted(sizes) and sizes[-1] < 64
    for t in (0.1, 1e-4):
        bits, k = sk.sizing(t)
        assert sk.blocked_rate(bits, k) <= t < min(sk.blocked_rate(bits - 2, j) for j in range(2, 22))
