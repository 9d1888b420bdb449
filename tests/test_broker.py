import pytest

from streamroute import __main__ as cli
from streamroute.broker import Broker
from streamroute.operators.filters import FilterError

SCHEMA = "i bigint, msg_id string, topic string, payload string, headers map<string,string>, status string"


def ident(n):
    return f"{n:032x}"


def test_publish_subscribe_deliver_acknowledge(spark, tmp_path):
    b = Broker(spark, f"file://{tmp_path}/b")
    mk = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    told = lambda df: [r["status"] for r in df.orderBy("place").collect()]
    b.subscribe("e", "early", "a.>", position="earliest")
    assert b.deliver().count() == 0 and b.pending().count() == 0
    first = [(0, ident(1), "a.x", '{"v": 1}', {"h": "1"}), (1, ident(1).upper(), "a.x", "{}", None), (2, None, "a.y", None, None), (3, ident(2), "", "{}", None), (4, ident(3), None, "{}", None)]
    assert told(b.publish(mk(first), "i")) == ["stored", "duplicate", "stored", "error 4000", "error 4000"]
    b.subscribe("l", "late", ">")
    b.subscribe("f", "picky", "a.*", filter="payload.v > 1")
    for m in ("m0", "m1"):
        b.subscribe(m, m, "g.>", grp="g")
    with pytest.raises(FilterError):
        b.subscribe("x", "x", ">", filter=">>>")
    second = [(i, ident(10 + i), t, p, None) for i, (t, p) in enumerate([("a.x", '{"v": 2}'), ("g.1", "no json"), ("g.2", "{}"), ("g.3", "{}")])] + [(9, ident(1), "a.x", "{}", None)]
    assert told(b.publish(mk(second), "i")) == ["stored"] * 4 + ["duplicate"]

    def dies(what, df, n=None):
        if what == "marks":
            raise RuntimeError
        return Broker._write(b, what, df, n)

    b._write = dies
    with pytest.raises(RuntimeError):
        b.deliver()
    del b._write
    got = sorted((r["consumer_id"], r["topic"]) for r in b.deliver().collect())
    want = [("early", "a.x"), ("early", "a.x"), ("early", "a.y"), ("late", "a.x"), ("late", "g.1"), ("late", "g.2"), ("late", "g.3"), ("m0", "g.1"), ("m0", "g.3"), ("m1", "g.2"), ("picky", "a.x")]
    assert got == want and b.deliver().count() == 0
    b.ack(spark.createDataFrame([(ident(10), "late", "done"), (ident(10), "picky", "rejected")], "msg_id string, consumer_id string, status string"))
    assert b.pending().count() == len(want) - 2  # one acknowledged, one without an id
    b.unsubscribe("l")
    assert [s["sub_id"] for s in b.subscriptions()] == ["e", "f", "m0", "m1"]


def test_command_line(spark, tmp_path, capsys):
    d = f"file://{tmp_path}/c"
    for i in range(3):
        assert cli.main(["pub", d, "t.a", f'{{"i": {i}}}']) == 0
    assert cli.main(["sub", d, "t.*", "--count", "2"]) == 0 and cli.main(["status", d]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 6 and '"events": 3' in out[-1]
    good, bad = tmp_path / "good.yaml", tmp_path / "bad.yaml"
    good.write_text('routes: [{name: r, match: {topic: "a.*", where: "v > 1"}, deliver: [{service: s}]}]')
    bad.write_text('routes: [{name: r, match: {topic: "a.*", where: "v >"}, deliver: [{service: s, where: ">>>"}]}]')
    assert cli.main(["config-check", str(good)]) == 0 and cli.main(["config-check", str(bad)]) == 1
    assert len(capsys.readouterr().out.splitlines()) == 3


def test_least_loaded_and_handlers(spark):
    from pyspark.sql import functions as F

    from streamroute.operators import delivery, groups

    members = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "grp string, consumer_id string, joined int")
    events = spark.createDataFrame([(1, "g", 5.0), (2, "g", 1.0), (3, "g", 1.0), (4, "g", None), (5, "g", 9.0), (6, "none", 1.0), (7, None, 1.0)], "ingest_seq bigint, grp string, cost double")
    got = {r["ingest_seq"]: r["member"] for r in groups.least_loaded(events, members, "joined", "cost").collect()}
    assert got == {1: "a", 2: "b", 3: "b", 4: "b", 5: "b", 6: None, 7: None}

    def handler(row):
        if row["v"] is None:
            raise ValueError("no value")

    rows = spark.createDataFrame([("m", "c", 1), ("n", "c", None), (None, None, 2)], "msg_id string, consumer_id string, v int")
    assert sorted(map(str, (tuple(r) for r in delivery.handle(rows, handler).collect()))) == sorted(map(str, [("m", "c", "done", None), ("n", "c", "rejected", "no value"), (None, None, "done", None)]))
    assert delivery.handle(rows.where(F.lit(False)), handler).count() == 0
