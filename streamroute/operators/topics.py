"""Topic patterns: `*` is one segment, `>` one or more at the end.

Patterns are matched by hash equi-joins. A pattern has a shape (its number of leading segments, which of them are
stars, whether a tail follows) and a key (those segments, stars in their places). Shapes are few; each distinct topic
gets its key under each shape and is joined on (shape, key), so neither regular expressions nor nested loops run over
events. A topic segment that is itself a star matches a star once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamroute.session import join_small

#: More distinct shapes than this in a pattern table is an error (they become columns of one expression).
MAX_SHAPES = 4096


def shape_of(pattern: str) -> tuple[bool, int, str, str]:
    """(has a tail, number of leading segments, mask of stars, key) of a pattern; what follows `>` is ignored."""
    parts = pattern.split(".")
    tail = ">" in parts
    if tail:
        parts = parts[: parts.index(">")]
    return tail, len(parts), "".join("1" if p == "*" else "0" for p in parts), ".".join(parts)


def matches(pattern: str, topic: str) -> bool:
    """The rule itself, for one pair."""
    tail, n, mask, _ = shape_of(pattern)
    want, got = pattern.split(".")[:n], topic.split(".")
    return (len(got) > n if tail else len(got) == n) and all(m == "1" or w == g for m, w, g in zip(mask, want, got))


def pattern_regex(pattern: str) -> str:
    """The same as a regular expression over the whole topic."""
    tail, n, mask, _ = shape_of(pattern)
    body = r"\.".join("[^.]*" if m == "1" else re.escape(p) for m, p in zip(mask, pattern.split(".")[:n]))
    rest = (r"\..*" if n else ".*") if tail else ""
    return rf"(?s)\A{body}{rest}\z"


def shaped(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The patterns with tail, n, mask and key columns, by built-in functions."""
    seg = F.split(F.col(pattern), r"\.", -1)
    at = F.array_position(seg, ">")
    out = patterns.where(F.col(pattern).isNotNull()).withColumn("__seg", F.when(at > 0, F.slice(seg, 1, F.greatest((at - 1).cast("int"), F.lit(0)))).otherwise(seg))
    return out.withColumns(
        {
            "__tail": at > 0,
            "__n": F.size("__seg"),
            "__mask": F.array_join(F.transform("__seg", lambda x: F.when(x == "*", "1").otherwise("0")), ""),
            "__key": F.array_join("__seg", "."),
        }
    ).drop("__seg")


def _keys(topic: Column, shapes: list[tuple[bool, int, str]]) -> Column:
    """All (tail, n, mask, key) under which a topic can be found."""
    seg = F.split(topic, r"\.", -1)
    size = F.size(seg)
    entries = []
    for tail, n, mask in shapes:
        stars = {i for i, m in enumerate(mask) if m == "1"}
        parts = [F.lit("*") if i in stars else F.get(seg, F.lit(i)) for i in range(n)]
        key = F.concat_ws(".", *parts) if parts else F.lit("")
        fits = size > n if tail else size == n
        entries.append(F.when(fits, F.struct(F.lit(tail).alias("__tail"), F.lit(n).alias("__n"), F.lit(mask).alias("__mask"), key.alias("__key"))))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def match_topics(topics: DataFrame, patterns: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """Each distinct topic of `topics` with every row of `patterns` whose pattern it matches (bag semantics: one row a
    pattern row). Null topics and null patterns match nothing. A column of the pattern table named like the topic
    column comes out as `<name>_of_pattern`. The few shapes come to the driver, nothing else does."""
    p = shaped(patterns.withColumnRenamed(topic, f"{topic}_of_pattern") if topic != pattern else patterns, pattern)
    shapes = [tuple(r) for r in p.select("__tail", "__n", "__mask").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} pattern shapes")
    distinct = topics.where(F.col(topic).isNotNull()).select(topic).distinct()
    if not shapes:
        return distinct.limit(0).join(p, F.lit(False), "inner").drop("__tail", "__n", "__mask", "__key")
    keyed = distinct.select(topic, F.explode(_keys(F.col(topic), sorted(shapes))).alias("__k")).select(topic, "__k.*")
    on = ["__tail", "__n", "__mask", "__key"]
    return join_small(keyed, p, on).drop(*on)


def route(events: DataFrame, subscriptions: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """Events with every matching subscription: one copy a subscription. Events stream by the (topic, subscription)
    map, which is broadcast when it was counted as small and joined with salted hot topics when it isn't. Columns of
    the subscriptions that the events have as well come out as `<name>_of_pattern`."""
    for c in set(subscriptions.columns) & set(events.columns) - {topic, pattern}:
        subscriptions = subscriptions.withColumnRenamed(c, f"{c}_of_pattern")
    found = match_topics(events, subscriptions, topic, pattern)
    return join_small(events, found, [topic])


def unrouted(events: DataFrame, subscriptions: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """Events no pattern matches, those without a topic included."""
    found = match_topics(events, subscriptions, topic, pattern).select(topic).distinct()
    return join_small(events, found, [topic], "left_anti")


def most_specific(matched: DataFrame, by: list[str], pattern: str = "pattern") -> DataFrame:
    """Of several matches per `by` the most specific one: exact before one star before more, before a tail; then the
    longer pattern, then the pattern itself. An option of ours; routing keeps all matches."""
    tail = F.contains(F.col(pattern), F.lit(">"))
    stars = F.length(pattern) - F.length(F.replace(F.col(pattern), F.lit("*"), F.lit("")))
    rank = F.struct(tail.cast("int"), stars, -F.length(pattern), F.col(pattern))
    cols = [c for c in matched.columns if c not in by]
    return matched.groupBy(*by).agg(F.min_by(F.struct(*cols), rank).alias("__m")).select(*by, *[F.col(f"__m.{c}").alias(c) for c in cols])


def without(subscriptions: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Subscriptions that weren't removed (by pattern and sub_id, say)."""
    return join_small(subscriptions, removed.select(*keys).distinct(), keys, "left_anti")


def permitted(requests: DataFrame, acl: DataFrame, by: list[str], topic: str = "topic", pattern: str = "pattern", denied: bool = False) -> DataFrame:
    """Requests whose topic matches any pattern granted to their `by` columns (denied: those that don't)."""
    found = match_topics(requests, acl, topic, pattern).select(topic, *by).distinct()
    return join_small(requests, found, [topic, *by], "left_anti" if denied else "left_semi")
