"""Consumer groups: which member gets an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamroute.operators.numbering import number_rows
from streamroute.session import join_small


def stable_hash(c: Column) -> Column:
    """Non-negative 60-bit hash of a text, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def members_of(members: DataFrame, order: str, group: str = "grp", member: str = "consumer_id") -> DataFrame:
    """One row a group: its members in joining order, as an array (a member that joins twice counts twice)."""
    rows = members.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    both = F.array_sort(F.collect_list(F.struct(order, member)))
    return rows.groupBy(group).agg(F.transform(both, lambda x: x[member]).alias("members"))


def assign(events: DataFrame, members: DataFrame, order: str, group: str = "grp", member: str = "consumer_id", seq: str = "ingest_seq", key: Column | None = None) -> DataFrame:
    """events (with their group) plus the member chosen.

    With a text key the member is hash(key) mod n; events whose key is null take turns (round robin by seq), and keyed
    events don't move the turn. Events of a group without members, and with a null group, get null.
    """
    lists = members_of(members, order, group, member)
    turns = events if key is None else events.withColumn("__key", key)
    keyed = F.lit(None).cast("string") if key is None else F.col("__key")
    turns = turns.withColumn("__turn", F.when(keyed.isNull(), F.lit(0)).otherwise(F.lit(1)))
    numbered = number_rows(turns, [group, "__turn"], seq, "__rn")
    with_list = join_small(numbered, lists, [group], "left")
    n = F.size("members")
    at = F.when(keyed.isNotNull(), F.pmod(stable_hash(keyed), n)).otherwise(F.pmod(F.col("__rn") - 1, n))
    return with_list.withColumn("member", F.when(n > 0, F.get(F.col("members"), at.cast("int")))).drop("__rn", "__turn", "__key", "members")


def members_after(log: DataFrame, order: str, group: str = "grp", member: str = "consumer_id", op: str = "op") -> DataFrame:
    """Members of each group after a log of joins ('add') and leaves ('remove'): a member's last entry counts; `joined` is
    its place in the order."""
    rows = log.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    last = rows.groupBy(group, member).agg(F.max_by(op, order).alias("__op"), F.max(order).alias("joined"))
    return last.where(F.col("__op") == "add").drop("__op")


def least_loaded(events: DataFrame, members: DataFrame, order: str, cost: str, group: str = "grp", member: str = "consumer_id", seq: str = "ingest_seq", name: str = "member") -> DataFrame:
    """events plus the member that had the least load before it (of equal ones the earliest to join); the event's cost is
    then added to it. Null costs weigh nothing. Sequential per group by definition: a group's rows stream through
    one task and a state of one number a member."""
    import numpy as np
    from pyspark.sql import types as T

    from streamroute.operators.folds import ordered_fold

    own = join_small(events, members_of(members, order, group, member).withColumnRenamed("members", "__members"), [group], "left")

    def step(load: dict, cols: dict) -> tuple[dict, list]:
        out = np.empty(len(cols["__members"]), object)
        for i, (names, c) in enumerate(zip(cols["__members"], cols[cost])):
            if names is not None and len(names):
                out[i] = min(names, key=lambda m: load.get(m, 0.0))
                load[out[i]] = load.get(out[i], 0.0) + (0.0 if c is None or c != c else float(c))
            else:
                out[i] = None
        return load, [out]

    return ordered_fold(own, [group], [seq], dict, step, [T.StructField(name, T.StringType())]).drop("__members")
