"""Who may do what: codes of refused requests, as a column instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamroute.operators.topics import permitted
from streamroute.session import join_small

#: Error codes.
BAD_REQUEST, BAD_CHECKSUM, NO_AUTH, FORBIDDEN, NO_NAMESPACE, TOO_LARGE, TOO_FAST, INTERNAL, OVERLOAD = 4000, 4001, 4010, 4030, 4040, 4090, 4290, 5000, 5030


def authenticate(requests: DataFrame, registry: DataFrame, anonymous: bool = False, namespace: str = "ns", service: str = "service_id", key: str = "api_key") -> DataFrame:
    """requests plus `code`: null where the key is the registered one of the service in its namespace, 4040 for an unknown
    namespace, 4010 for an unknown service or another key. Nulls are unknown. anonymous: everything is let in. A service
    registered with several keys may use each of them."""
    if anonymous:
        return requests.withColumn("code", F.lit(None).cast("int"))
    spaces = registry.where(F.col(namespace).isNotNull()).select(namespace).distinct().withColumn("__space", F.lit(True))
    keys = registry.where(F.col(namespace).isNotNull() & F.col(service).isNotNull() & F.col(key).isNotNull()).groupBy(namespace, service).agg(F.collect_set(key).alias("__keys"))
    out = join_small(join_small(requests, spaces, [namespace], "left"), keys, [namespace, service], "left")
    known = F.coalesce(F.array_contains("__keys", F.col(key)), F.lit(False))
    return out.withColumn("code", F.when(F.col("__space").isNull(), NO_NAMESPACE).when(~known, NO_AUTH).cast("int")).drop("__space", "__keys")


def refused(requests: DataFrame, acl: DataFrame, by: list[str], size: str | None = None, most: int | None = None, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """requests (with a `code`, null so far let in) with the codes of empty topics, payloads above `most` bytes and topics
    that no granted pattern matches."""
    code = F.when(F.coalesce(F.col(topic), F.lit("")) == "", BAD_REQUEST)
    if size:
        code = code.when(F.col(size) > F.lit(most), TOO_LARGE)
    out = requests.withColumn("code", F.coalesce("code", code))
    open_ = out.where("code is null")
    denied = permitted(open_, acl, by, topic, pattern, denied=True).withColumn("code", F.lit(FORBIDDEN))
    return out.where("code is not null").unionByName(permitted(open_, acl, by, topic, pattern)).unionByName(denied)
