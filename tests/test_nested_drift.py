import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamroute import session
from streamroute.operators import drift, nested

BODIES = "request_id bigint, gateway_id string, file_no int, body string, topic string, value string"


def bodies(spark, texts):
    return spark.createDataFrame([(i, "g", 1, t, "clash", "clash") for i, t in enumerate(texts)], BODIES)


def found(spark, texts):
    rows = nested.node_links(nested.nodes(bodies(spark, texts))).collect()
    return sorted(tuple(r) for r in rows)


def test_links_of_repeated_objects_and_headers(spark):
    body = {"topic": "t", "data": {"items": [{"sku": 1, "lots": [{"lot": "a"}, {"lot": "b"}]}, 5, {"ship": {"to": [{"x": 1}]}}], "m": [[{"q": 1}]], "tags": ["x"]}, "headers": {"a.b": None, "c": "d"}}
    assert found(spark, [json.dumps(body)]) == sorted(
        [
            (0, 0, "data.items[0]", "data"), (0, 0, "data.items[0].lots[0]", "data.items[0]"), (0, 0, "data.items[0].lots[1]", "data.items[0]"), (0, 0, "data.items[2]", "data"),
            (0, 0, "data.items[2].ship.to[0]", "data.items[2]"), (0, 0, "data.m[0][0]", "data"), (0, 0, "headers.a.b", "headers"), (0, 0, "headers.c", "headers"),
        ]
    )


def test_batches_strings_holding_json_and_bodies_that_are_none(spark):
    texts = [
        json.dumps({"events": [{"topic": "t", "data": [{"a": 1}, 3]}, 7, {"topic": "u", "data": json.dumps({"x": [{"y": 1}]}), "headers": [1]}]}),
        json.dumps({"topic": "t", "data": json.dumps([{"a": 1}])}),
        "", None, "{", "[1]", "3", '{"data":{"a":[{"b":NaN}]}}', '{"data": [{"a": 1}]} x', '{"events": null, "data": [{}]}',
    ]
    assert found(spark, texts) == [(0, 0, "data[0]", "data"), (0, 2, "data.x[0]", "data"), (9, 0, "data[0]", "data")]


def test_empty_table_and_very_long_and_deep_bodies(spark):
    assert nested.triples(bodies(spark, ["{}"]).limit(0)).count() == 0
    long = json.dumps({"data": {"text": "x" * 2_000_000, "rows": [{"i": i} for i in range(3000)]}})
    assert len(found(spark, [long])) == 3000
    deep = '{"data": ' + '{"a": [' * 3000 + "1" + "]}" * 3000 + "}"
    rows = nested.stream_events(deep)[0].data
    assert sum(1 for t in rows if t[4] == "object") == 2999 and rows[-1][1] == "data" + ".a[0]" * 3000
    assert nested.dumps(nested.parse(deep)).count("[") == 3000


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, false, null, "\\u00e9\\n"], "b": {}}', "[]", "[[], {}]", ' { "x" : [ ] } ', '"s"', "12"])
def test_the_token_stream_agrees(text):
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else json.loads(v) if isinstance(v, nested.Number) else v
    for tree in (nested._tree(nested.tokens(text)), nested.parse(text), nested._tree(nested._spelled(nested.parse(text))), nested.parse(nested.dumps(nested.parse(text)))):
        assert plain(tree) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "tru", '"a', "01", "1 2", "{1:2}", '["\t"]', '{"a":1]', '[1}', '{"a":1 "b":2}', "]", ",", '{"a":NaN}', '{"a":1}}', '{,}', '{"a"}', '{"a\n":1}', "[,1]", '{"a":,}'])
def test_the_token_stream_refuses_what_is_no_json(text):
    with pytest.raises(ValueError):
        list(nested.tokens(text))


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


def by_walking(data):
    """Rows of a tree by plain recursion."""
    out = []

    def go(v, g, p, node, field, element):
        if isinstance(v, dict):
            if element:
                node, field = (g, p, node[1]), ""
                out.append((*node, "", "object", None))
            for k, x in v.items():
                go(x, f"{g}.{k}", f"{p}.{k}", node, f"{field}.{k}" if field else k, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, g + "[]", f"{p}[{i}]", node, field + "[]", True)
        else:
            out.append((g, p, node[1], "", nested.kind_of(v), nested.text_of(v)) if element else (*node, field, nested.kind_of(v), nested.text_of(v)))

    go(data, "data", "data", ("data",) * 3, "", False)
    return out


@settings(max_examples=200, deadline=None)
@given(JSON.filter(lambda v: isinstance(v, (dict, list))), st.sampled_from([None, 1]), st.booleans())
def test_the_stream_gives_what_a_walk_of_the_tree_gives(data, indent, twice):
    body = json.dumps({"topic": "t", "data": data}, indent=indent)
    if twice:  # a key given twice: the last counts
        body = '{"topic": "u", "data": [{"x": 1}], ' + body.strip()[1:]
    (event,) = nested.stream_events(body)
    assert event.topic == "t" and event.data[0][4] == "root"
    assert event.data[1:] == by_walking(nested.parse(json.dumps(data)))


def test_digits_and_halves_of_surrogate_pairs_are_kept_or_marked(spark):
    long = "9" * 6000
    body = '{"data": {"n": ' + long + ', "d": 1.50, "e": 1e999, "bad\\ud800": "x\\udc00y", "l": [{"k\\ud800": 1}]}, "headers": {"h": {"a": 1.50}, "\\ud800": "v"}}'
    got = {r["node_path"]: (r["fields"], r["kinds"]) for r in nested.nodes(bodies(spark, [body])).collect()}
    fields, kinds = got["data"]
    assert fields == {"n": long, "d": "1.50", "e": "1e999", "bad?": "x?y"} and kinds == {"n": "number", "d": "number", "e": "number", "bad?": "string"}
    assert got["headers.h"][0] == {"name": "h", "value": '{"a":1.50}'} and got["headers.?"][0]["value"] == "v"
    assert drift.file_statistics(bodies(spark, ['{"topic": "t", "data": {"a\\ud800": "\\ud800", "b": 1' + "0" * 400 + "}}"])).count() > 0
    assert drift.path_values(bodies(spark, ['{"topic": "t", "data": {"a\\ud800": "\\ud800"}}'])).collect()[0]["value"] == "?"


def test_flat_tables_keep_links_and_values(spark):
    body = {"data": {"id": "o1", "items": [{"sku": "s", "qty": 2}, {"sku": None}], "tags": ["p", "q"]}, "headers": {"h": "v"}}
    got = nested.flat_tables(bodies(spark, [json.dumps(body)]))
    t = got.tables
    assert set(t) == {"data", "data.items[]", "data.tags[]", "headers"} and got.rest.count() == 0
    items = {r["node_path"]: (r["parent_path"], r["sku"], r["qty"]) for r in t["data.items[]"].collect()}
    assert items == {"data.items[0]": ("data", "s", "2"), "data.items[1]": ("data", None, None)}
    assert [r["value"] for r in t["data.tags[]"].orderBy("node_path").collect()] == ["p", "q"]
    assert [(r["name"], r["value"]) for r in t["headers"].collect()] == [("h", "v")]


def test_fields_whose_names_would_clash_keep_columns_of_their_own(spark, tmp_path):
    body = {"data": {"a.b": 1, "a_b": 2, "A_B": 3, "a": {"b": 4}, "node_path": 5, "value": 6, "é": 7}}
    t = nested.flat_tables(bodies(spark, [json.dumps(body), "{}"])).tables["data"]
    t.write.parquet(f"{tmp_path}/t")
    assert len({c.lower() for c in t.columns}) == len(t.columns) == 4 + 7
    assert sorted(v for v in t.drop(*nested.LINKS).collect()[0]) == ["1", "2", "3", "4", "5", "6", "7"]
    assert t.collect()[0]["a_b"] == "2"


def test_keys_that_are_data_lose_nothing(spark):
    texts = [json.dumps({"data": {"users": {f"u{i}": [{"n": i}]}, f"k{i}": i}}) for i in range(40)]
    got = nested.flat_tables(bodies(spark, texts), max_groups=5, max_fields=10)
    assert len(got.tables) == 5 and "data" not in got.tables
    profile = {(r["grp"], r["field"]): (r["n_rows"], r["n_values"]) for r in nested.table_profiles(got).collect()}
    assert profile == {**{("data", f"k{i}"): (1, 1) for i in range(40)}, **{(f"data.users.u{i}[]", "n"): (1, 1) for i in range(40)}}
    assert nested.table_profiles(nested.flat_tables(bodies(spark, texts).limit(0))).count() == 0


def event(topic, **data):
    return json.dumps({"topic": topic, "data": data})


def files(spark, rows):
    return spark.createDataFrame([(i, g, f, b, None, None) for i, (g, f, b) in enumerate(rows)], BODIES)


def report(spark, rows):
    return sorted(tuple(r)[1:] for r in drift.changes(drift.file_statistics(files(spark, rows))).collect())


def sample(seed, n=20):
    r = random.Random(seed)
    return [{"id": f"ord-{r.randrange(10**6):06d}", "qty": r.randrange(1, 12), "total": round(r.uniform(5, 900), 2), "region": r.choice(["NORTH", "COAST", "HILLS"]), "ok": r.random() < 0.5} for _ in range(n)]


def test_added_removed_retyped_and_renamed(spark):
    rows = [("g", 1, event("t", **s)) for s in sample(1)]
    for s in sample(2):
        rows.append(("g", 2, event("t", ref=s["id"], quantity=s["qty"], total=str(s["total"]), region=s["region"], note="n")))
    assert report(spark, rows) == sorted(
        [
            ("t", 2, "renamed", "id", "ref"), ("t", 2, "renamed", "qty", "quantity"), ("t", 2, "retyped", "total", ""), ("t", 2, "added", "note", ""), ("t", 2, "removed", "ok", ""),
        ]
    )


def test_a_field_counts_from_one_fifth_on_and_nulls_dont(spark):
    rows = [("g", 1, event("t", a=1)) for _ in range(10)]
    rows += [("g", 2, event("t", a=1, b=1 if i < 2 else None, c=1 if i < 1 else None)) for i in range(10)]
    assert report(spark, rows) == [("t", 2, "added", "b", "")]


def test_different_kinds_of_values_are_no_rename(spark):
    rows = [("g", 1, event("t", a=s["qty"], b=s["region"])) for s in sample(3)] + [("g", 2, event("t", c=s["qty"] * 1000, d=s["id"])) for s in sample(4)]
    assert {x[2] for x in report(spark, rows)} == {"added", "removed"}


def test_topic_renamed_and_topics_that_pause(spark):
    rows = [("g", f, event("old", **s)) for f in (1, 2) for s in sample(f)] + [("g", f, event("new", **s)) for f in (3, 4) for s in sample(f)]
    rows += [("g", f, event("pauses", a=1)) for f in (1, 2, 4)] + [("g", 3, event("other", zzz="q"))]
    assert report(spark, rows) == [("old", 3, "topic_renamed", "", "new")]


def test_drift_over_nothing_and_over_unusable_rows(spark):
    assert report(spark, []) == []
    assert report(spark, [("g", 1, None), (None, 1, event("t", a=1)), ("g", None, event("t", a=1)), ("g", 1, '{"data":{"a":1}}'), ("g", 1, event("t"))]) == []


def test_one_consistent_table_with_failed_casts(spark):
    rows = [("g", 1, event("old", **s)) for s in sample(5)]
    rows += [("g", 2, json.dumps({"topic": "new", "data": {"id": s["id"], "qty": "many" if i == 0 else str(s["qty"]), "total": s["total"], "region": s["region"], "ok": s["ok"], "l": [{"x": 1}, {"x": 2}]}})) for i, s in enumerate(sample(6, 8))]
    requests = files(spark, rows)
    values = drift.consistent_values(requests, drift.changes(drift.file_statistics(requests)))
    casts = {(r["topic"], r["field_path"]): (r["type"], r["n_values"], r["n_failed"]) for r in drift.cast_report(values).collect()}
    assert casts[("new", "qty")] == ("number", 28, 1)
    assert casts[("new", "id")] == ("string", 28, 0)
    t = drift.consistent_table(values, "new", {"id": "string", "total": "number", "l[].x": "number"})
    assert t.count() == 28 and dict(t.dtypes)["total"] == "double"
    assert {tuple(r["l_x"]) for r in t.where("file_no = 2").collect()} == {(1.0, 2.0)}


def test_one_table_over_gateways_of_which_one_renames(spark):
    plain = [{k: v for k, v in s.items() if k != "ok"} for s in (*sample(21), *sample(22), *sample(23), *sample(24))]
    rows = [(g, 1 + i // 20, event("order", **s)) for g in ("g1", "g2") for i, s in enumerate(plain[:40])]
    rows += [("g3", 1, event("order", **s)) for s in plain[:20]]
    rows += [("g3", 2, event("shop.order", **s)) for s in plain[20:40]]
    rows += [("g3", 3, event("shop.order", **{("ref" if k == "id" else k): v for k, v in s.items()})) for s in plain[40:60]]
    rows += [("g4", f, event("order", **s)) for f in (1, 2) for s in plain[60:]]
    requests = files(spark, rows)
    values = drift.consistent_values(requests, drift.changes(drift.file_statistics(requests))).cache()
    assert {(r["last_topic"], r["last_path"]) for r in values.collect()} == {("order", p) for p in ("id", "qty", "total", "region")}
    for topic, field in (("order", "id"), ("shop.order", "ref")):
        t = drift.consistent_table(values, topic, {field: "string", "total": "number"})
        assert t.count() == len(rows) and t.where(f"{field} is null or total is null").count() == 0


def test_names_used_side_by_side_stay_apart(spark):
    rows = [("g1", 1, event("t", id=s["id"], total=s["total"])) for s in sample(31)] + [("g1", 2, event("t", ref=s["id"], total=s["total"])) for s in sample(32)]
    rows += [("g2", f, event("t", id=s["id"], ref="other", total=s["total"])) for f in (1, 2) for s in sample(33)]
    requests = files(spark, rows)
    values = drift.consistent_values(requests, drift.changes(drift.file_statistics(requests)))
    got = {(r["gateway_id"], r["path"], r["last_path"]) for r in values.where("path <> 'total'").collect()}
    assert got == {("g1", "id", "ref"), ("g1", "ref", "ref"), ("g2", "id", "id"), ("g2", "ref", "ref")}


def test_large_vocabularies_of_different_formats_are_no_rename(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    mail, path = lambda: f"{word()}@{word()}.org", lambda: f"/{word()}/{word()}/{word()}"
    batch = lambda make: json.dumps({"events": [{"topic": "t", "data": {k: f() for k, f in make.items()}} for _ in range(2000)]})
    rows = [("g", f, batch({name: make})) for f, name, make in ((1, "a", mail), (2, "b", path), (3, "c", path)) for _ in range(10)]
    assert report(spark, rows) == [("t", 2, "added", "b", ""), ("t", 2, "removed", "a", ""), ("t", 3, "renamed", "b", "c")]


def test_values_that_differ_only_late_are_of_different_kinds(spark):
    head = "x" * 300
    rows = [("g", 1, event("t", a=f"{head}-{i}:{'q' * i}")) for i in range(1, 21)] + [("g", 2, event("t", b=f"{head}/{'z' * i}/{i}/w")) for i in range(1, 21)]
    assert {x[2] for x in report(spark, rows)} == {"added", "removed"}


def test_keys_that_are_data_are_no_fields(spark):
    rows = [("g", f, event("t", a=i, **{f"id{f}_{i}": 1})) for f in (1, 2) for i in range(30)]
    assert report(spark, rows) == []


@pytest.mark.parametrize("names", [[f"k{i}" for i in range(10_001)], [f"k{i}" + "x" * 20_000 for i in range(120)]], ids=["many", "long"])
def test_no_side_that_grows_with_the_fields_passes_through_the_driver(spark, monkeypatch, names):
    sizes, broadcast = [], session.F.broadcast

    def spy(df):
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
        sizes.append(tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()))
        return broadcast(df)

    monkeypatch.setattr(session.F, "broadcast", spy)
    wide = dict.fromkeys(names, True)
    rows = [("g", 1, event("t", **s, **wide)) for s in sample(41, 3)] + [("g", 2, event("t", **{("ref" if k == "id" else k): v for k, v in s.items()}, **wide)) for s in sample(42, 3)]
    assert report(spark, rows) == [("t", 2, "renamed", "id", "ref")]
    assert sizes and all(n <= 20_000 and b <= 4 << 20 for n, b in sizes)


def test_topics_that_turn_are_joined_without_broadcasts(spark):
    rows = [("g", 1, "t", "p", 1), ("g", 1, "t", "q", 1), ("g", 2, "u", "p", 1), ("g", 2, "u", "q", 1)]
    types = spark.createDataFrame([(*r[:1], r[2], r[1], r[3], "string") for r in rows], "gateway_id string, topic string, file_no int, path string, type string")
    events = types.select("gateway_id", "topic", "file_no").distinct()
    for df, n in zip(drift.turns(events, types), (1, 2)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == n
