"""Hash ring: owner and replicas of a topic. The ring is nodes times virtual nodes, a bounded table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamroute.operators.groups import stable_hash
from streamroute.session import join_small

#: Virtual nodes per node.
VNODES = 128
#: Equal slices the ring is looked up by.
SLICES = 256


def position(text: str) -> int:
    """60-bit position of a text; the same as groups.stable_hash."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


class HashRing:
    """Nodes on a ring. Adding a node twice changes nothing; `version` counts changes."""

    def __init__(self, nodes: list[str] = (), vnodes: int = VNODES):
        self.vnodes, self.version = vnodes, 0
        self.nodes: list[str] = []
        for n in nodes:
            self.add(n)

    def add(self, node: str) -> None:
        if node not in self.nodes:
            self.nodes.append(node)
            self.version += 1

    def remove(self, node: str) -> None:
        if node in self.nodes:
            self.nodes.remove(node)
            self.version += 1

    def apply(self, event: str, node: str) -> None:
        """Topology events: joined and recovered add, dead removes, suspect is ignored."""
        if event in ("joined", "recovered"):
            self.add(node)
        elif event == "dead":
            self.remove(node)

    def points(self) -> list[tuple[int, str]]:
        return sorted({position(f"{n}#{i}"): n for n in self.nodes for i in range(self.vnodes)}.items())

    def owners(self, replicas: int = 0) -> list[tuple[int, list[str]]]:
        """(position, the next distinct nodes clockwise from it, owner first) for every point."""
        pts = self.points()
        out = []
        for i, (p, _) in enumerate(pts):
            seen: list[str] = []
            for _, n in pts[i:] + pts[:i]:
                if n not in seen:
                    seen.append(n)
                if len(seen) > replicas:
                    break
            out.append((p, seen))
        return out


def place(topics: DataFrame, ring: HashRing, replicas: int = 0, topic: str = "topic") -> DataFrame:
    """topics plus `owners`: the owner and up to `replicas` further nodes; empty for an empty ring, null for a null
    topic."""
    table = ring.owners(replicas)
    if not table:
        return topics.withColumn("owners", F.when(F.col(topic).isNotNull(), F.array().cast("array<string>")))
    # successor on the ring: topics and points are ordered by position together within each topic's slice of the ring;
    # a slice holds the points from its first position to the next one after its end, so no topic looks elsewhere
    cut = SLICES
    size = (1 << 60) // cut
    rows = []
    for i in range(cut):
        inside = [(p, n) for p, n in table if i * size <= p < (i + 1) * size]
        nxt = next(((p, n) for p, n in table if p >= (i + 1) * size), table[0])
        rows.append((i, [p for p, _ in inside], [n for _, n in inside] + [nxt[1]]))
    spark = topics.sparkSession
    slices = spark.createDataFrame(rows, "slice int, points array<bigint>, nodes array<array<string>>")
    distinct = topics.select(topic).where(F.col(topic).isNotNull()).distinct()
    h = stable_hash(F.col(topic))
    keyed = distinct.withColumn("__h", h).withColumn("slice", F.floor(F.col("__h") / F.lit(size)).cast("int"))
    below = F.size(F.filter("points", lambda p: p < F.col("__h")))
    found = keyed.join(F.broadcast(slices), "slice").select(topic, F.get("nodes", below).alias("owners"))
    return join_small(topics, found, [topic], "left")


def nodes_after(events: DataFrame, order: str, node: str = "node", event: str = "event") -> DataFrame:
    """Nodes of a ring after a log of topology events: joined and recovered add, dead removes, others change nothing.
    changes: how often the node really came or went."""
    from pyspark.sql import Window

    real = events.where(F.col(node).isNotNull() & F.col(event).isin("joined", "recovered", "dead")).withColumn("__in", F.col(event) != "dead")
    was = F.coalesce(F.lag("__in").over(Window.partitionBy(node).orderBy(order)), F.lit(False))
    steps = real.withColumn("__new", (F.col("__in") != was).cast("bigint"))
    return steps.groupBy(node).agg(F.max_by("__in", order).alias("in_ring"), F.sum("__new").alias("changes"))
