"""Queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute.functions.msgid import canonical_id, canonical_sql
from streamroute.llm import bpe, mixing, seen_keys, spam
from streamroute.session import table

#: Target rate of false positives of the filters, and absent keys asked for to tell it.
SEEN_TARGET, SEEN_PROBES = 1e-7, 30_000_000


def _answers(spark: SparkSession, d: str, probes: int = 0) -> DataFrame:
    rows = table(spark, d, "pub_messages").select("ingest_seq", canonical_id("msg_id").alias("mid"))
    past = table(spark, d, "wal_replays").select(F.explode("event_ids").alias("event_id")).select(canonical_id("event_id").alias("old"))
    return seen_keys.seen_before(rows, F.col("mid"), "ingest_seq", past, F.col("old"), SEEN_TARGET, probes=probes)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("kind = 'row' and seen").select("ingest_seq")


def p6_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.error_rate(_answers(spark, d, SEEN_PROBES), SEEN_TARGET)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.token_sizes(table(spark, d, "documents"))
    return mixing.sample_mixes(sizes, mixing.plan_mixes(sizes, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.token_sizes(table(spark, d, "documents"))
    plan = mixing.plan_mixes(sizes, table(spark, d, "mix_targets"))
    return mixing.reached_shares(mixing.sample_mixes(sizes, plan), plan)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spam.flagged(spam.label_pages(docs, spam.fit_on(docs))).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Characters of every page by the labels of its lines."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spam.label_pages(docs, spam.fit_on(docs))


QUERIES = {f.__name__: f for f in (p6_found, p6_rate, p7_ids, p8_mix, p8_shares, p9_found, p9_shares)}

_MID = canonical_sql("msg_id")
SQL = {
    "p6_found": f"""
        with m as (select ingest_seq, {_MID} as mid from pub_messages),
        old as (select distinct {canonical_sql("e")} as mid from (select unnest(event_ids) as e from wal_replays)),
        f as (select mid, min(ingest_seq) as first_seq from m where mid is not null group by 1)
        select ingest_seq from m join f using (mid) where ingest_seq > first_seq or mid in (select mid from old where mid is not null)""",
}
