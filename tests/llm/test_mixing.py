import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from streamroute.llm import mixing

SIZES = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "mix_id string, source string, target_share double, max_repeats int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 5), st.integers(0, 1000)), min_size=1, max_size=8), st.floats(0, 4000))
def test_water_filling(pairs, total):
    share, cap = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
    a = mixing.water_fill(share, cap, total)
    assert (a <= cap + 1e-6).all() and (a[share == 0] == 0).all()
    assert abs(a.sum() - min(total, cap[share > 0].sum())) < 1e-6 * max(1, total)
    free = (share > 1e-9) & (a < cap - 1e-6) & (a > 0)
    if free.sum() > 1:
        level = a[free] / share[free]
        assert level.max() - level.min() < 1e-6 * level.max()
    # no clamped source is below the level of the free ones
    if free.any():
        assert (a[(share > 1e-9) & ~free] <= (a[free] / share[free]).max() * share[(share > 1e-9) & ~free] + 1e-6).all()


def sizes(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 20) for i in range(50)] + [(20_000, "one", 100), (30_000, "zero", 0)]
    return spark.createDataFrame(rows, SIZES)


def test_mix_reaches_its_shares_within_the_caps(spark):
    s = sizes(spark)
    t = spark.createDataFrame(
        [("m", "big", 0.6, 1), ("m", "small", 0.3, 3), ("m", "one", 0.1, 2), ("m", "lacking", 0.5, 9), ("m", "zero", 0.2, 4), (None, "big", 1.0, 1), ("m", None, 1.0, 1), ("n", "small", None, None), ("n", "big", -1.0, 1), ("o", "small", 2.0, None), ("o", "small", 1.0, 2)],
        TARGETS,
    )
    plan = mixing.plan_mixes(s, t)
    got = mixing.sample_mixes(s, plan)
    report = {(r["mix_id"], r["source"]): r for r in mixing.reached_shares(got, plan).collect()}
    assert report["m", "small"]["tokens"] == 3 * 1000 and report["m", "one"]["tokens"] == 200
    assert report["m", "lacking"]["tokens"] == 0 and report["n", "small"]["tokens"] == 0
    assert report["o", "small"]["tokens"] == 1000
    for r in report.values():
        assert r["most_repeats"] <= (r["max_repeats"] or 0) and abs(r["reached_share"] - r["planned_share"]) < 0.002
    rows = got.collect()
    assert len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows) and min(r["repeats"] for r in rows) >= 1


def test_the_seed_decides_and_the_total_can_be_set(spark):
    s = sizes(spark)
    t = spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    plan = mixing.plan_mixes(s, t, total_tokens=12_000)
    pick = lambda seed: {r["doc_id"] for r in mixing.sample_mixes(s.repartition(3), plan, seed).collect()}
    a, b = pick(1), pick(2)
    assert a == pick(1) and a != b
    n = {r["doc_id"]: r["n_tokens"] for r in s.collect()}
    assert abs(sum(n[d] for d in a) - 12_000) <= 20


def test_empty_tables_and_rows_without_source(spark):
    none = spark.createDataFrame([], SIZES)
    t = spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    plan = mixing.plan_mixes(none, t)
    assert mixing.sample_mixes(none, plan).count() == 0
    assert [(r["tokens"], r["reached_share"]) for r in mixing.reached_shares(mixing.sample_mixes(none, plan), plan).collect()] == [(0, 0.0)]
    assert mixing.plan_mixes(sizes(spark), t.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a b", None, 7), (2, "c d e", "s", 7), (3, None, "s", 7), (4, "", "s", 7)], "doc_id bigint, text string, source string, n_tokens int")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in mixing.token_sizes(docs).collect()) == [(2, 3), (3, 0), (4, 0)]
