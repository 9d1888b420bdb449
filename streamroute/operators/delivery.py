"""Delivery lifecycle: in-flight, acknowledgements, timeouts, backoff, dead letters, state of a message."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamroute.operators.topics import match_topics, most_specific
from streamroute.session import join_small

KEY = ["msg_id", "consumer_id"]


def in_flight(deliveries: DataFrame, order: str = "delivered_at") -> DataFrame:
    """The last delivery per message and consumer: tracking again overwrites. Rows with a null key part are left out."""
    rows = deliveries.where(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())
    cols = [c for c in deliveries.columns if c not in KEY]
    last = F.max_by(F.struct(*cols), F.struct(F.col(order), *[c for c in cols if c != order])).alias("__d")
    return rows.groupBy(*KEY).agg(last).select(*KEY, *[F.col(f"__d.{c}").alias(c) for c in cols])


def pending(tracked: DataFrame, acks: DataFrame, until: Column | None = None) -> DataFrame:
    """Tracked deliveries no acknowledgement (up to a time) removes; a rejection doesn't remove."""
    done = acks.where(F.coalesce(F.col("status") != "rejected", F.lit(True)))
    if until is not None:
        done = done.where(F.col("acked_at") <= until)
    return tracked.join(done.select(*KEY).distinct(), KEY, "left_anti")


def timed_out(tracked: DataFrame, acks: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Pending deliveries older than the timeout (strictly) at `now`."""
    return pending(tracked, acks, now).where(F.col("delivered_at") < now - F.make_dt_interval(secs=F.lit(seconds)))


def backoff_seconds(attempt: Column, initial: float = 1.0, maximum: float = 60.0, multiplier: float = 2.0) -> Column:
    """Delay before the next try; attempt 0 counts as 1."""
    return F.least(F.lit(initial) * F.pow(F.lit(multiplier), F.greatest(attempt - 1, F.lit(0))), F.lit(maximum))


def decide(attempt: Column, most: int | Column, counting: str = "code") -> Column:
    """'dlq' or 'retry' after a failed delivery. counting='code': the next attempt's number is compared;
    'docs': this attempt's."""
    n = attempt + 1 if counting == "code" else attempt
    return F.when(n >= (most if isinstance(most, Column) else F.lit(most)), "dlq").otherwise("retry")


def dead_letters(failed: DataFrame, most: int = 5, counting: str = "code") -> DataFrame:
    """One entry per message and consumer whose failures reached the limit: topic, dlq topic, attempts, first and last
    failure."""
    hit = failed.where(decide(F.col("attempt"), most, counting) == "dlq")
    return hit.groupBy(*KEY).agg(
        F.min("topic").alias("original_topic"), F.concat(F.lit("dlq."), F.min("topic")).alias("dlq_topic"), F.max("attempt").alias("attempts"),
        F.min("failed_at").alias("first_error_at"), F.max("failed_at").alias("last_error_at"),
    )


def replay(dlq: DataFrame, now: Column, retention_hours: int = 168) -> DataFrame:
    """Entries young enough to be sent again, under their original topic and as a first attempt."""
    young = dlq.where(F.col("last_error_at") >= now - F.make_dt_interval(hours=F.lit(retention_hours)))
    return young.select(*KEY, F.col("original_topic").alias("topic"), F.lit(1).alias("attempt"))


def message_state(deliveries: DataFrame, most: int = 5) -> DataFrame:
    """State per message over its consumers: a consumer's latest row tells done, dlq, retry or delivered; the message
    is finished when each of its consumers is done or dead-lettered."""
    last = in_flight(deliveries)
    state = (
        F.when(F.col("ack_status").isin("done", "ok", "duplicate"), "done")
        .when((F.col("ack_status") == "rejected") & (decide(F.coalesce("attempt", F.lit(1)), most) == "dlq"), "dlq")
        .when(F.col("ack_status") == "rejected", "retry")
        .otherwise("delivered")
    )
    each = last.withColumn("state", state)
    return each.groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("n_consumers"), F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("state") == "dlq").alias("n_dlq"),
        F.count_if(F.col("state") == "retry").alias("n_retry"), F.bool_and(F.col("state").isin("done", "dlq")).alias("finished"),
    )


ACKS = "msg_id string, consumer_id string, status string, reason string"


def handle(deliveries: DataFrame, handler: Callable[[dict], None]) -> DataFrame:
    """Run a consumer's handler on every delivery, batch by batch on the executors: acknowledgements with status 'done', or
    'rejected' and the error's text where it raised one. The handler gets the row as a dict and may run again for a
    row whose task is repeated."""
    names = deliveries.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    handler(row)
                    out.append((row[KEY[0]], row[KEY[1]], "done", None))
                except Exception as e:  # noqa: BLE001 - whatever a handler raises is its verdict on the event
                    out.append((row[KEY[0]], row[KEY[1]], "rejected", str(e)))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["msg_id", "consumer_id", "status", "reason"])

    return deliveries.select(*names).mapInArrow(run, ACKS)


def sdk_retry_delay_ms(attempt: Column, base: int = 100) -> Column:
    """Publisher's delay before try `attempt` + 1 (attempt counts from 0)."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def redeliveries(failed: DataFrame, overrides: DataFrame, most: int = 5, counting: str = "code", initial: float = 1.0, maximum: float = 60.0, multiplier: float = 2.0) -> DataFrame:
    """Failed deliveries (topic, attempt, failed_at) with what follows: decision ('retry' or 'dlq'), the next attempt's
    number and its time `due_at` (both null for dlq). overrides: pattern, most: a topic's limit is that of its most
    specific pattern, else `most`."""
    limits = most_specific(match_topics(failed, overrides.select(F.col("pattern").alias("__pattern"), F.col("most").alias("__most")), "topic", "__pattern"), ["topic"], "__pattern")
    out = join_small(failed, limits.select("topic", "__most"), ["topic"], "left")
    decision = decide(F.col("attempt"), F.coalesce("__most", F.lit(most)), counting)
    due = F.col("failed_at") + F.make_dt_interval(secs=backoff_seconds(F.col("attempt") + 1, initial, maximum, multiplier))
    again = decision == "retry"
    out = out.withColumns({"decision": decision, "next_attempt": F.when(again, F.col("attempt") + 1), "due_at": F.when(again, due)})
    return out.drop("__most")


def live_subscriptions(last_seen: DataFrame, now: Column, hours: float = 168, at: str = "seen_at") -> DataFrame:
    """Subscriptions seen within the time; those never seen (null) have no age and stay."""
    return last_seen.where(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(secs=F.lit(float(hours) * 3600))))


def reconnect_delay_seconds(attempt: Column, initial: float = 1.0, maximum: float = 30.0, tries: int = 10) -> Column:
    """A client's delay before reconnection `attempt` (from 1): doubled up to a maximum, null once all tries are used."""
    return F.when(attempt <= tries, F.least(F.lit(initial) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(maximum)))
