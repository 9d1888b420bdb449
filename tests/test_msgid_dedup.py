import datetime as dt
import random

from pyspark.sql import functions as F

from streamroute.functions.msgid import canonical_id
from streamroute.operators import dedup

ID = "0185ac54-d046-7f70-9d00-7f473a2f0af4"
BARE = ID.replace("-", "")


def test_written_forms_of_an_id(spark):
    forms = [ID, BARE, ID.upper(), f" {ID}", f"{ID}\n", "{" + ID + "}", f"urn:uuid:{ID}", f"URN:UUID:{ID.upper()}"]
    bad = [None, "", "x", ID[:-1], ID + "0", "g" + ID[1:], "0185ac54"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(forms + bad)], "i int, v string")
    got = {r["i"]: r["c"] for r in rows.select("i", canonical_id("v").alias("c")).collect()}
    assert [got[i] for i in range(len(forms))] == [BARE] * len(forms)
    assert [got[len(forms) + i] for i in range(len(bad))] == [None] * len(bad)


SCHEMA = "delivery_id bigint, mid string, consumer string, attempt int, at timestamp_ntz, __rnx string, rn string"


def keys():
    return [F.col("mid"), F.col("consumer")]


def order():
    return [F.col(c).asc_nulls_last() for c in ("attempt", "at", "delivery_id")]


def random_rows(n: int, seed: int):
    r = random.Random(seed)
    t = dt.datetime(2024, 1, 1)
    return [
        (i, r.choice([None, "hot", "hot", "hot", f"m{r.randrange(n // 3)}"]), r.choice([None, "a", "b"]), r.choice([None, 1, 2]), r.choice([None, t, t + dt.timedelta(seconds=r.randrange(3))]), "x", "y")
        for i in range(n)
    ]


def brute(rows):
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    late = dt.datetime.max
    surplus = set()
    for g in groups.values():
        g.sort(key=lambda r: (r[3] is None, r[3] or 0, r[4] is None, r[4] or late, r[0]))
        surplus |= {r[0] for r in g[1:]}
    return surplus


def test_copies_against_brute_force_with_nulls_ties_and_a_hot_key(spark):
    rows = random_rows(900, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for salts in (1, 3, 64):
        marked = dedup.mark_copies(df, keys(), order(), salts=salts)
        assert marked.columns == [*df.columns, "is_copy"]
        assert {r["delivery_id"] for r in marked.where("is_copy").collect()} == brute(rows)
        assert marked.count() == len(rows)
    kept = {r["delivery_id"] for r in dedup.keep_first(df, keys(), order()).collect()}
    assert kept == {r[0] for r in rows} - brute(rows)


def test_exactly_repeated_rows_leave_one(spark):
    row = (1, "m", "c", 1, None, None, None)
    df = spark.createDataFrame([row] * 40, SCHEMA).repartition(4)
    assert dedup.mark_copies(df, keys(), order()).where("is_copy").count() == 39
    assert dedup.keep_first(df, keys(), order()).count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup.mark_copies(df, keys(), order()).count() == 0
    assert dedup.keep_first(df, keys(), order()).count() == 0


def test_keep_first_limits_before_the_shuffle(spark):
    plan = dedup.keep_first(spark.createDataFrame([(1, "m", "c", 1, None, None, None)], SCHEMA), keys(), order())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_batches_against_stored_identifiers_survive_a_repeat(spark, tmp_path):
    rows = random_rows(600, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", keys(), order(), ["m", "c"])
    kept = []
    for batch in range(3):
        part = df.where(F.col("delivery_id") % 3 == batch)
        first = {r["delivery_id"] for r in store.take(batch, part).collect()}
        again = {r["delivery_id"] for r in store.take(batch, part).collect()}  # the run is repeated after a failure
        assert first == again
        kept += first
    keyed = [r for r in rows if r[1] is not None and r[2] is not None]
    got = [r for r in keyed if r[0] in set(kept)]
    assert len({(r[1], r[2]) for r in got}) == len(got) == len({(r[1], r[2]) for r in keyed})
    assert len(kept) == len(got) + len(rows) - len(keyed)
