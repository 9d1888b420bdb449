"""Route rules: topic pattern, content filter, transforms and several targets with filters of their own."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamroute.operators.filters import FilterError, compile_filter
from streamroute.operators.numbering import number_rows
from streamroute.operators.topics import match_topics, route
from streamroute.operators.transforms import Op, transformed
from streamroute.session import join_small


@dataclass
class Target:
    service: str
    group: str | None = None
    where: str | None = None


@dataclass
class Rule:
    name: str
    pattern: str
    deliver: list[Target]
    where: str | None = None
    transforms: list[Op] = field(default_factory=list)
    enabled: bool = True


def _own_filter(number: Column, conditions: list[Column]) -> Column:
    """Does a row pass the filter it is numbered with? Each row evaluates its own one only; -1 and null stand for none."""
    out = F.lit(True)
    for i, c in reversed(list(enumerate(conditions))):
        out = F.when(number == i, c).otherwise(out)
    return out


class _Filters:
    """Distinct filters of rules or subscriptions, compiled once each."""

    def __init__(self, fields, always: Column):
        self.fields, self.always = fields, always
        self.numbers: dict[tuple, int] = {}
        self.conditions: list[Column] = []

    def number(self, *texts: str | None) -> int:
        """The number of the filter that all the texts make, -1 for none. FilterError for an invalid one."""
        key = tuple(t for t in texts if t)
        if not key:
            return -1
        if key not in self.numbers:
            both = [compile_filter(t, self.fields, "payload") for t in key]
            self.numbers[key] = len(self.conditions)
            self.conditions.append(self.always | reduce(lambda a, b: a & b, both))
        return self.numbers[key]


def apply_rules(events: DataFrame, rules: list[Rule], fields, topic: str = "topic", payload_json: str | None = None, encoding: str | None = None, headers: str | None = None) -> DataFrame:
    """Events with each target of each enabled rule they match: rule, service, grp (in place of columns of these names),
    and the transformed payload if payload_json names a JSON column (and headers, if `headers` names a map column).

    Distinct topics are matched with the rules' patterns by hash joins; an event then meets its own rules only, and of
    their filters each row evaluates the one of its target. Filters see the original payload under the alias `payload`.
    Events whose encoding column says 'raw' pass content filters. A rule with an invalid filter is an error before any
    job runs.
    """
    raw = F.coalesce(F.col(encoding) == "raw", F.lit(False)) if encoding else F.lit(False)
    filters, rows, names, ops = _Filters(fields, raw), [], [], []
    for r in (r for r in rules if r.enabled):
        for t in r.deliver:
            rows.append((len(rows), filters.number(r.where, t.where), r.pattern))
            names.append(F.struct(F.lit(r.name).alias("rule"), F.lit(t.service).alias("service"), F.lit(t.group).cast("string").alias("grp")))
            ops.append(r.transforms)
    kept = [F.col(f"`{c}`") for c in events.columns if c not in ("rule", "service", "grp")]
    if not rows:
        return events.limit(0).select(*kept, *[F.lit("").alias(c) for c in ("rule", "service", "grp")])
    targets = events.sparkSession.createDataFrame(rows, "__target int, __filter int, __pattern string")
    found = match_topics(events, targets, topic, "__pattern").drop("__pattern")
    out = join_small(events, found, [topic]).where(_own_filter(F.col("__filter"), filters.conditions))
    out = out.select(*kept, "__target", F.element_at(F.array(*names), F.col("__target") + 1).alias("__name"))
    if payload_json and any(ops):
        out = _transform(out, ops, payload_json, headers)
    return out.select(*[F.col(f"`{c}`") for c in events.columns if c not in ("rule", "service", "grp")], "__name.*")


def _transform(out: DataFrame, ops: list[list[Op]], payload: str, headers: str | None) -> DataFrame:
    """Each row's payload (and headers) after the operations of its target."""
    schema = "struct<body:string,headers:map<string,string>>"

    @F.pandas_udf(schema)
    def run(which: pd.Series, text: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = [transformed(t, ops[i], None if h is None else list(h.items() if isinstance(h, dict) else h)) for i, t, h in zip(which, text, given)]
        return pd.DataFrame({"body": pd.Series([r[0] for r in rows], dtype=object), "headers": pd.Series([None if r[1] is None else dict(r[1]) for r in rows], dtype=object)})

    given = F.col(headers) if headers else F.lit(None).cast("map<string,string>")
    out = out.withColumn("__new", run(F.col("__target"), F.col(payload), given)).withColumn(payload, F.col("__new.body"))
    return out.withColumn(headers, F.col("__new.headers")) if headers else out


def deliver(events: DataFrame, subscriptions: list[dict], fields, topic: str = "topic", once_per_consumer: bool = False, seq: str | None = None) -> DataFrame:
    """Deliveries to subscriptions (dicts with sub_id, consumer_id, pattern, grp, filter, position, since): one copy a
    subscription, or of the subscriptions of one consumer that an event passes only the first one's. An invalid filter is
    dropped, as if there were none. With `seq`, a subscription at 'latest' gets only events after its `since`. Neither
    looks at ids, so events without one are delivered like others."""
    filters, rows = _Filters(fields, F.lit(False)), []
    for i, s in enumerate(subscriptions):
        try:
            number = filters.number(s.get("filter"))
        except FilterError:
            number = -1
        since = s.get("since") if seq and s.get("position") == "latest" else None
        rows.append((i, s["sub_id"], s["consumer_id"], s["pattern"], s.get("grp"), number, since))
    subs = events.sparkSession.createDataFrame(rows, "sub_no int, sub_id string, consumer_id string, pattern string, grp string, filter_no int, since bigint")
    own = ["sub_no", "sub_id", "consumer_id", "pattern", "grp", "filter_no", "since"]
    name = {c: f"{c}_of_pattern" if c in events.columns else c for c in own}

    def passes(get) -> Column:
        late = F.coalesce(F.col(seq) > get("since"), F.lit(False)) if seq else F.lit(True)
        return _own_filter(get("filter_no"), filters.conditions) & (get("since").isNull() | late)

    if not once_per_consumer:
        out = route(events, subs, topic, "pattern")
        return out.where(passes(lambda c: F.col(name[c]))).drop(*[name[c] for c in ("sub_no", "filter_no", "since")])
    # the subscriptions of a topic are control data: they travel as one array and are thinned out within the event's row
    lists = match_topics(events, subs, topic, "pattern").groupBy(topic).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("__subs"))
    out = join_small(events, lists, [topic]).withColumn("__subs", F.filter("__subs", lambda s: passes(lambda c: s[c])))
    consumers = F.transform("__subs", lambda s: s["consumer_id"])
    first = F.filter("__subs", lambda s, i: s["consumer_id"].isNull() | (F.array_position(consumers, s["consumer_id"]) == i + 1))
    out = out.withColumn("__s", F.explode(first))
    return out.select(*[F.col(f"`{c}`") for c in events.columns], *[F.col(f"__s.{c}").alias(name[c]) for c in own if c not in ("sub_no", "filter_no", "since")])


def collect_subscriptions(table: DataFrame, most: int = 100_000) -> list[dict]:
    """A subscription table (control data) as dicts; more than `most` rows is an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} subscriptions")
    return [r.asDict() for r in rows]


def request_replies(requests: DataFrame, replies: DataFrame, seconds: float, reply_to: str = "reply_to", topic: str = "topic", at: str = "at") -> DataFrame:
    """Requests with the replies sent to their inbox topic within the time. Inboxes are cut into spans of that time; a
    request looks into its own span and the next, so a hot inbox is spread over its spans. Rows without a time or an
    inbox match nothing."""
    width = max(int(seconds * 1_000_000), 1)
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width))
    r = replies.select(F.col(topic).alias("__inbox"), F.col(at).alias("reply_at"), F.col("msg_id").alias("reply_id"), span(at).alias("__span")).where(F.col("__inbox").isNotNull())
    q = requests.withColumn("__mine", F.explode(F.array(span(at), span(at) + 1)))
    on = (F.col(reply_to) == F.col("__inbox")) & (F.col("__mine") == F.col("__span")) & (F.col("reply_at") >= F.col(at)) & (F.col("reply_at") <= F.col(at) + F.make_dt_interval(secs=F.lit(seconds)))
    return q.join(r, on).drop("__inbox", "__span", "__mine")


def within_capacity(deliveries: DataFrame, by: list[str], seq: str, capacity: int = 4096, name: str = "sent") -> DataFrame:
    """deliveries plus whether each still finds room in its consumer's queue of `capacity` (per `by`, in the order of seq), as
    a broker that never waits would tell. Nothing is dropped here: the rows come out with their flag."""
    return number_rows(deliveries, by, seq, "__place").withColumn(name, F.col("__place") <= F.lit(capacity)).drop("__place")
