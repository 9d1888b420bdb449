import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamroute.operators import filters, topics
from streamroute.operators.filters import FilterEnd, FilterError, FilterParse, FilterToken, StructFields, VariantFields, compile_filter, evaluate, parse

GOLDEN = [
    ("amount > 1000", {"amount": 1500}, True), ("amount > 1000", {"amount": 500}, False), ('status == "active"', {"status": "active"}, True), ('status == "active"', {"status": "inactive"}, False),
    ("payload.amount > 1000", {"payload": {"amount": 2000}}, True), ('amount > 100 AND status == "active"', {"amount": 200, "status": "active"}, True),
    ('amount > 100 AND status == "active"', {"amount": 50, "status": "active"}, False), ('status == "active" OR status == "pending"', {"status": "pending"}, True),
    ('NOT status == "deleted"', {"status": "deleted"}, False), ('contains(name,"test")', {"name": "test-service"}, True), ('contains(name,"test")', {"name": "prod"}, False),
    ('starts_with(region,"VN")', {"region": "VN-HCM"}, True), ('in(status,["active","pending"])', {"status": "closed"}, False), ("field != null", {"field": "v"}, True), ("field != null", {}, False),
    ('(a > 1 AND b > 2) OR c == "yes"', {"a": 5, "b": 5, "c": "no"}, True), ("NOT x == 5", {}, True), ("len(s,2)", {"s": "é"}, True), ("len(x) > 5", {"x": "abcdefgh"}, False), ("a > 1 garbage", {"a": 2}, True),
    ("in(x,[1.5])", {"x": 1.5}, False), ("in(x,[true])", {"x": True}, False), ("in(x,[2])", {"x": 2}, True), ("a.b == null", {"a": [1]}, True), ("x == [1]", {"x": [1]}, False), ("x != [1]", {}, True),
]
#: x against: == 5, != 5, > 5, == "a", != "a", == true, != true, == null, != null
TRUTH = {
    "{}": "FTFFTFTTF", '{"x":null}': "FFFFFFFTF", '{"x":5}': "TFFFFFFFT", '{"x":6.0}': "FTTFFFFFT", '{"x":"a"}': "FFFTFFFFT", '{"x":"5"}': "FFFFTFFFT", '{"x":true}': "FFFFFTFFT", '{"x":[1]}': "FFFFFFFFT", '{"x":{}}': "FFFFFFFFT",
}
TESTS = ["x == 5", "x != 5", "x > 5", 'x == "a"', 'x != "a"', "x == true", "x != true", "x == null", "x != null"]


def compiled(spark, pairs, **kw):
    """Results of (filter, payload) pairs over variants."""
    texts = list(dict.fromkeys(t for t, _ in pairs))
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (_, p) in enumerate(pairs)], "i int, j string").select("i", F.parse_json("j").alias("data"))
    rows = {r["i"]: r for r in df.select("i", *[compile_filter(t, VariantFields("data"), **kw).alias(f"f{n}") for n, t in enumerate(texts)]).collect()}
    return [rows[i][f"f{texts.index(t)}"] for i, (t, _) in enumerate(pairs)]


def test_golden_cases(spark):
    assert [evaluate(parse(t), p) for t, p, _ in GOLDEN] == [w for *_, w in GOLDEN]
    assert compiled(spark, [(t, p) for t, p, _ in GOLDEN]) == [w for *_, w in GOLDEN]


def test_truth_table(spark):
    pairs = [(t, json.loads(j)) for j in TRUTH for t in TESTS]
    want = [c == "T" for j in TRUTH for c in TRUTH[j]]
    assert [evaluate(parse(t), p) for t, p in pairs] == want
    assert compiled(spark, pairs) == want


def test_nan_is_never_larger(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    fields = StructFields(df.schema)
    assert df.select(*[compile_filter(t, fields).alias(f"c{i}") for i, t in enumerate(["x > 5", "x == 5", "x != 5", "x != null"])]).collect()[0][:] == (False, False, True, True)


@pytest.mark.parametrize(("text", "error"), [("", FilterEnd), (">>>", FilterEnd), ("a = 1", FilterParse), ("a && b", FilterParse), ("a == 1.2.3", FilterParse), ('a == "x', FilterParse), ("f(a)", FilterParse), ("a == ==", FilterToken), ("a ==", FilterEnd), ("(a > 1", FilterParse), ("in(a,[1", FilterParse), ("a. > 1", FilterParse)])
def test_errors(text, error):
    with pytest.raises(error):
        parse(text)


def test_strict_mode_and_alias(spark):
    assert compiled(spark, [("len(x) > 2", {"x": "abc"}), ("len(x) <= 2", {"x": [1, 2]}), ("payload.x == null", {"y": 1})], strict=True, root_alias="payload") == [True, True, True]
    with pytest.raises(FilterError):
        parse("a > 1 garbage", strict=True)


values = st.one_of(st.none(), st.booleans(), st.integers(-3, 6), st.sampled_from([0.5, 5.0, 1e300]), st.sampled_from(["a", "5", "é", ""]), st.lists(st.integers(0, 2), max_size=2), st.dictionaries(st.sampled_from("bc"), st.integers(0, 5), max_size=2))
paths = st.sampled_from(["a", "b", "a.b", "b.c"])
literals = st.sampled_from(["5", "-1", "0.5", '"a"', "'5'", "true", "false", "null", "[1]"])
leaf = st.one_of(
    st.tuples(paths, st.sampled_from(["==", "!=", ">", "<", ">=", "<="]), literals).map(" ".join),
    st.tuples(st.sampled_from(["contains", "starts_with", "ends_with", "len", "in"]), paths, st.sampled_from(['"a"', "1", "2", '[1, "a", 5]', "[]", "null"])).map(lambda x: f"{x[0]}({x[1]}, {x[2]})"),
)
exprs = st.recursive(leaf, lambda e: st.one_of(st.tuples(e, st.sampled_from([" AND ", " or "]), e).map("".join), e.map(lambda x: f"NOT ({x})"), e.map(lambda x: f"({x})")), max_leaves=4)
payloads = st.dictionaries(st.sampled_from("ab"), values, max_size=2)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(exprs, payloads), min_size=15, max_size=25))
def test_compiled_filters_agree_with_the_interpreter(spark, pairs):
    assert compiled(spark, pairs) == [evaluate(parse(t), p) for t, p in pairs]


def test_struct_fields_nulls_and_types(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("o", T.StructType([T.StructField("b", T.BooleanType())]))])
    df = spark.createDataFrame([(1, None, (True,)), (None, "x", None)], schema)
    got = lambda t, **kw: [r[0] for r in df.select(compile_filter(t, StructFields(schema, **kw))).collect()]
    assert got("n != 5") == [True, True] and got("n != 5", nulls_are="null") == [True, False]
    assert got("o.b == true") == [True, False] and got('s == "x"') == [False, True] and got("n == 'x'") == [False, False] and got("zzz == null") == [True, True]


MATCHES = [
    ("order.created", "order.created", True), ("order.created", "order", False), ("order.*", "order.updated", True), ("order.*", "order.us.created", False), ("order.*", "order", False),
    ("order.>", "order.us.vn.created", True), ("order.>", "order", False), ("*", "order", True), ("*", "a.b", False), (">", "a.b.c", True), (">", "", True), ("a.*.c", "a..c", True), ("a.*.c", "a.c", False),
    ("order.*", "order.", True), ("order.>", "order.", True), ("a.>.z", "a.b", True), ("a.>.z", "a", False),
]


def test_golden_matches(spark):
    assert [topics.matches(p, t) for p, t, _ in MATCHES] == [w for *_, w in MATCHES]
    import re

    assert [bool(re.fullmatch(topics.pattern_regex(p).removesuffix(r"\z").removeprefix("(?s)"), t, re.S)) for p, t, _ in MATCHES] == [w for *_, w in MATCHES]


segments = st.sampled_from(["a", "b", "", "x.y"])
topic_texts = st.lists(segments, min_size=1, max_size=4).map(".".join)
pattern_texts = st.lists(st.sampled_from(["a", "b", "", "*", ">"]), min_size=1, max_size=4).map(".".join)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(topic_texts, min_size=1, max_size=12), st.lists(pattern_texts, min_size=1, max_size=12))
def test_joins_agree_with_the_rule(spark, ts, ps):
    events = spark.createDataFrame([(i, t) for i, t in enumerate([*ts, None])], "id int, topic string")
    subs = spark.createDataFrame([(i, p, "clash") for i, p in enumerate([*ps, None])], "sub int, pattern string, id string")
    got = sorted((r["id"], r["sub"]) for r in topics.route(events, subs).collect())
    assert got == sorted((i, j) for i, t in enumerate(ts) for j, p in enumerate(ps) if topics.matches(p, t))
    lost = sorted(r["id"] for r in topics.unrouted(events, subs).collect())
    assert lost == sorted(set(range(len(ts) + 1)) - {i for i, _ in got})


def test_no_patterns_and_no_topics(spark):
    events = spark.createDataFrame([(1, "a")], "id int, topic string")
    subs = spark.createDataFrame([], "sub int, pattern string")
    assert topics.route(events, subs).count() == 0 and topics.unrouted(events, subs).count() == 1
    assert topics.route(events.limit(0), spark.createDataFrame([(1, ">")], "sub int, pattern string")).count() == 0


def test_the_match_is_an_equi_join(spark):
    events = spark.createDataFrame([(1, "a")], "id int, topic string")
    subs = spark.createDataFrame([(1, "*"), (2, "a.>")], "sub int, pattern string")
    plan = topics.route(events, subs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(filters.compile_filter("id > 5", StructFields(df.schema)))._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters" in plan
