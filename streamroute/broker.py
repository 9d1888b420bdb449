"""Publish, subscribe, deliver and acknowledge over a folder all executors share.

Every step writes one numbered folder and counts once that is whole; a step that dies is done again under the same
number and gives the same rows. Publishers retry under the same message id and get 'duplicate' for what is stored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute.functions.msgid import canonical_id
from streamroute.operators import delivery, groups, routing
from streamroute.operators.dedup import SeenStore
from streamroute.operators.filters import VariantFields, compile_filter
from streamroute.session import children, written

EVENTS = "ingest_seq bigint, msg_id string, topic string, payload string, headers map<string,string>"
DELIVERIES = "msg_id string, consumer_id string, sub_id string, grp string, topic string, payload string, headers map<string,string>, ingest_seq bigint, attempt int, delivered_at timestamp"
ACKS = "msg_id string, consumer_id string, status string, reason string, acked_at timestamp"
#: Positions a batch may use; ingest_seq is the batch's number times this plus the place in it.
SPAN = 1 << 40


class Broker:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ids = SeenStore(spark, f"{self.path}/ids", [F.col("msg_id")], [F.col("place")], ["ident"])

    def _numbers(self, what: str) -> list[int]:
        at = f"{self.path}/{what}"
        return sorted(int(n[2:]) for n in children(self.spark, at) if n.startswith("n=") and written(self.spark, f"{at}/{n}"))

    def _read(self, what: str, schema: str, after: int = -1, whole: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{what}/n={n}" for n in self._numbers(what) if n > after and (whole is None or n in whole)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, what: str, df: DataFrame, n: int | None = None) -> int:
        n = max([-1, *self._numbers(what)]) + 1 if n is None else n
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/n={n}")
        return n

    def publish(self, messages: DataFrame, order: str) -> DataFrame:
        """Store messages (msg_id, topic, payload as JSON text, headers) in the given order (a unique integer column): place,
        msg_id and status, 'stored', 'duplicate' or 'error 4000' (no topic). Messages without an id are stored as they
        are; ids are compared in their canonical form."""
        n = max([-1, *self._numbers("events")]) + 1
        have_headers = F.col("headers") if "headers" in messages.columns else F.lit(None)
        rows = messages.select(F.col(order).cast("bigint").alias("place"), canonical_id("msg_id").alias("msg_id"), "topic", "payload", have_headers.cast("map<string,string>").alias("headers"))
        valid = F.coalesce(F.col("topic") != "", F.lit(False))
        kept = self.ids.take(n, rows.where(valid))
        events = kept.select((F.lit(n).cast("bigint") * F.lit(SPAN) + F.col("place")).alias("ingest_seq"), "msg_id", "topic", "payload", "headers")
        self._write("events", events, n)
        stored = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events/n={n}").select((F.col("ingest_seq") - F.lit(n).cast("bigint") * F.lit(SPAN)).alias("place"), F.lit("stored").alias("status"))
        told = rows.select("place", "msg_id", valid.alias("valid")).join(stored, "place", "left")
        return told.select("place", "msg_id", F.coalesce("status", F.when(F.col("valid"), "duplicate").otherwise("error 4000")).alias("status"))

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def subscribe(self, sub_id: str, consumer_id: str, pattern: str, grp: str | None = None, filter: str | None = None, position: str = "latest") -> None:  # noqa: A002
        """From now on ('latest') or from the beginning ('earliest'). FilterError for an invalid filter."""
        if filter:
            compile_filter(filter, VariantFields("data"), "payload")
        since = (max([-1, *self._numbers("events")]) + 1) * SPAN - 1
        sub = {"sub_id": sub_id, "consumer_id": consumer_id, "pattern": pattern, "grp": grp, "filter": filter, "position": position, "since": since}
        self._control({"add": sub})

    def unsubscribe(self, sub_id: str) -> None:
        self._control({"remove": sub_id})

    def _control(self, entry: dict) -> None:
        self._write("control", self.spark.createDataFrame([(json.dumps(entry),)], "entry string"))

    def subscriptions(self) -> list[dict]:
        """Those that hold now, in the order they were made. They are control data and come to the driver."""
        out: dict[str, dict] = {}
        for n in self._numbers("control"):
            entry = json.loads(self.spark.read.parquet(f"{self.path}/control/n={n}").first()["entry"])
            if "add" in entry:
                out[entry["add"]["sub_id"]] = entry["add"]
            else:
                out.pop(entry["remove"], None)
        return list(out.values())

    def deliver(self) -> DataFrame:
        """Deliver what was published since the last run: one copy a subscription, in a group one copy to the member whose
        turn it is."""
        n = max([-1, *self._numbers("marks")]) + 1  # a run without its mark is done again
        upto = max([-1, *self._numbers("events")])
        before = self.spark.read.parquet(f"{self.path}/marks/n={n - 1}").first()["upto"] if n else -1
        subs = self.subscriptions()
        events = self._read("events", EVENTS, before)
        data = events.withColumn("data", F.expr("try_parse_json(payload)"))
        routed = routing.deliver(data, subs, VariantFields("data"), seq="ingest_seq").drop("data", "pattern")
        single = routed.where("grp is null")
        members = [(s["grp"], s["consumer_id"], s["sub_id"], i) for i, s in enumerate(subs) if s["grp"]]
        shared = routed.where("grp is not null").dropDuplicates(["ingest_seq", "grp"]).drop("consumer_id", "sub_id")
        table = self.spark.createDataFrame(members, "grp string, consumer_id string, sub_id string, joined int")
        shared = groups.assign(shared, table.select("grp", "joined", F.to_json(F.struct("consumer_id", "sub_id")).alias("consumer_id")), "joined")
        who = F.from_json("member", "consumer_id string, sub_id string")
        shared = shared.withColumns({"consumer_id": who["consumer_id"], "sub_id": who["sub_id"]}).drop("member")
        out = single.unionByName(shared).withColumns({"attempt": F.lit(1), "delivered_at": F.current_timestamp()})
        self._write("deliveries", out.select(*[c.split()[0] for c in DELIVERIES.split(", ")]), n)
        self._write("marks", self.spark.createDataFrame([(n, upto)], "run bigint, upto bigint"), n)
        return self.spark.read.schema(DELIVERIES).parquet(f"{self.path}/deliveries/n={n}")

    def ack(self, acks: DataFrame) -> None:
        """Acknowledgements: msg_id, consumer_id, status (done, ok, rejected ...), reason."""
        reason = F.col("reason") if "reason" in acks.columns else F.lit(None).cast("string")
        self._write("acks", acks.select("msg_id", "consumer_id", "status", reason.alias("reason"), F.current_timestamp().alias("acked_at")))

    def pending(self) -> DataFrame:
        """Deliveries without an acknowledgement that ends them."""
        return delivery.pending(delivery.in_flight(self._read("deliveries", DELIVERIES, whole=self._numbers("marks")).drop("headers")), self._read("acks", ACKS))


def temporary(spark: SparkSession) -> Broker:
    """A broker in a new folder of the shared one."""
    from streamroute.session import shared_dir

    return Broker(spark, f"{shared_dir(spark)}/broker-{uuid.uuid4().hex}")
