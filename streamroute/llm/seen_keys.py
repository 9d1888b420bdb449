"""Has this key been seen before? Saved blocked Bloom filters over hash-partitioned keys.

Keys are hashed to 64 bits and hash-partitioned; each partition has a blocked filter (512-bit blocks, all bits of a key
in one block), sized for the keys it can get and the target rate of false positives. Rows come in arrival order; each is
queried, then inserted. Filters are saved with every batch and loaded by the next, so earlier keys are neither kept nor
read again. A partition whose filter is full gets a further layer, twice as large and with half the rate, so any number
of keys can follow and the sum of the rates stays within the target. Layers of the same size merge by OR.

A key that holds a large part of all rows doesn't gather in one task: before the shuffle every Arrow batch answers the
repeats it can see itself, and only the first row of a key in a batch goes to the key's filter; answered rows are
spread by their number.

Wrong answers are measured, not assumed: beside every query the filter is asked for a key that is absent by
construction (no 16-byte key can equal it), for the keys just inserted, and at the end for as many more absent hashes as
it takes to tell the target.

What a batch answers depends on which rows it holds, so rows should come from a table or another source that gives them
in the same order when a task is run again.

Defined results: a null key was never seen and is never stored, nor is a row without a number (it has no place in the
order). Rows with the same key and the same number (repeated
rows): one counts as the first, the others as seen.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamroute.session import children, shared_dir, written

#: Keys one filter may be sized for; more keys make more partitions.
KEYS_PER_FILTER = 4_000_000
BLOCK_BITS = 512
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A full-avalanche mix of 64-bit values (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def blocked_rate(bits_per_key: float, k: int) -> float:
    """False-positive rate of a blocked filter: the fill of a block follows the Poisson-distributed number of its keys."""
    load = BLOCK_BITS / bits_per_key
    rate, p = 0.0, math.exp(-load)
    for i in range(1, int(load * 8) + 60):
        p *= load / i
        rate += p * (1 - (1 - 1 / BLOCK_BITS) ** (k * i)) ** k
    return rate


def sizing(target: float) -> tuple[int, int]:
    """Fewest bits a key, and the number of hash bits, whose rate is at most the target."""
    for bits in range(6, 400, 2):
        rate, k = min((blocked_rate(bits, k), k) for k in range(2, 22))
        if rate <= target:
            return bits, k
    raise ValueError(f"no blocked filter reaches a rate of {target}")


class BlockedBloom:
    def __init__(self, capacity: int, target: float):
        self.bits, self.k = sizing(target)
        self.blocks = max(1, math.ceil(capacity * self.bits / BLOCK_BITS))
        self.words = np.zeros(self.blocks * (BLOCK_BITS // 64), np.uint64)

    def _at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = ((mix64(h, 0) >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        word, bit = np.empty((self.k, len(h)), np.int64), np.empty((self.k, len(h)), np.uint64)
        for i in range(self.k):
            if i % 7 == 0:
                g = mix64(h, 1 + i // 7)
            pos = (g >> np.uint64(9 * (i % 7))) & np.uint64(BLOCK_BITS - 1)
            word[i] = (block * np.uint64(BLOCK_BITS // 64) + (pos >> np.uint64(6))).astype(np.int64)
            bit[i] = np.uint64(1) << (pos & np.uint64(63))
        return word, bit

    def query(self, h: np.ndarray) -> np.ndarray:
        """Bit by bit; hashes that have failed are left out of the next step."""
        out, left, hs = np.zeros(len(h), bool), np.arange(len(h)), h
        block = ((mix64(h, 0) >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        base = block * np.uint64(BLOCK_BITS // 64)
        for i in range(self.k):
            if i % 7 == 0:
                g = mix64(hs, 1 + i // 7)
            pos = (g >> np.uint64(9 * (i % 7))) & np.uint64(BLOCK_BITS - 1)
            hit = (self.words[(base + (pos >> np.uint64(6))).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) != 0
            if not hit.all():
                left, hs, base, g = left[hit], hs[hit], base[hit], g[hit]
        out[left] = True
        return out

    def insert(self, h: np.ndarray) -> None:
        word, bit = self._at(h)
        np.bitwise_or.at(self.words, word.ravel(), bit.ravel())

    def merge(self, other: BlockedBloom) -> None:
        """Take in the keys of a filter of the same size."""
        if (self.blocks, self.k) != (other.blocks, other.k):
            raise ValueError("filters of different sizes don't merge")
        self.words |= other.words


class Layers:
    """The filters of one partition: the last one takes new keys until it is full, then a larger one follows."""

    def __init__(self, capacity: int, target: float):
        self.capacity, self.target = capacity, target
        self.filters: list[BlockedBloom] = []
        self.counts: list[int] = []

    def _new(self) -> None:
        i = len(self.filters)
        self.filters.append(BlockedBloom(self.capacity << i, self.target / 2 ** (i + 1)))
        self.counts.append(0)

    def load(self, layer: int, n_keys: int, words: bytes) -> None:
        """Layers come in order."""
        self._new()
        self.filters[layer].words = np.frombuffer(words, np.uint64).copy()
        self.counts[layer] = n_keys

    def query(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for f in self.filters:
            out |= f.query(h)
        return out

    def insert(self, h: np.ndarray) -> None:
        """Hashes that aren't in yet, each once."""
        if not self.filters or self.counts[-1] + len(h) > self.capacity << (len(self.filters) - 1):
            self._new()
        self.filters[-1].insert(h)
        self.counts[-1] += len(h)

    def false_yes(self, n: int, salt: int, step: int = 1 << 20) -> int:
        """How many of n further absent hashes are answered with yes."""
        return sum(int(self.query(mix64(np.arange(i, min(n, i + step), dtype=np.uint64), 1000 + salt)).sum()) for i in range(0, n, step))


def absent_twin(h: np.ndarray) -> np.ndarray:
    """Hash of a key one byte longer than any real one: absent by construction."""
    return mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5), 77)


def _first_of(h: np.ndarray) -> np.ndarray:
    """True at the first position of each value."""
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    return first


def _answer_in_batch(batches: Iterator) -> Iterator:
    """Before the shuffle: repeats within a batch are answered."""
    import pyarrow as pa

    for batch in batches:
        h, seq = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        order = np.lexsort((seq, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        cols = [h, seq, again, np.where(again, seq, h)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "seq", "answered", "lane"])


STATE = "part int, parts int, layer int, capacity bigint, n_keys bigint, words binary"
ANSWERS = f"kind string, seq bigint, seen boolean, n_probes bigint, n_false bigint, n_missed bigint, {STATE}"
_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]


class SeenFilters:
    """Filters in a shared path, a folder a batch.

    ``take(batch_no, rows, key, number)`` tells for each row of a batch whether its key occurred in an earlier batch or
    row, and saves the filters as that batch leaves them. A batch that is taken again (after a failure) starts from the
    filters of the batch before it and gives the same answers.
    """

    def __init__(self, spark: SparkSession, path: str, target: float = 1e-6, keys_per_filter: int = KEYS_PER_FILTER):
        self.spark, self.path, self.target, self.keys_per_filter = spark, path.rstrip("/"), target, keys_per_filter

    def state(self, before: int | None = None) -> DataFrame | None:
        """The newest saved filters (of batches before a number), None where there are none."""
        done = [int(n[6:]) for n in children(self.spark, self.path) if n.startswith("batch=") and written(self.spark, f"{self.path}/{n}")]
        done = [n for n in done if before is None or n < before]
        return self.spark.read.schema(ANSWERS).parquet(f"{self.path}/batch={max(done)}").where("kind = 'filter'") if done else None

    def take(self, batch_no: int, rows: DataFrame, key: Column, number: Column, probes: int = 0, expected: int = 0) -> DataFrame:
        """kind 'row' with seq and seen for every row; kind 'filter' for every filter: n_keys, n_probes (absent keys asked
        for, `probes` more of them over all filters), n_false (of them answered with yes), n_missed (stored keys answered
        with no, always 0) and words. expected: rows that are known to follow, for the size of the first filters."""
        spark = self.spark
        mine = rows.select(F.xxhash64(key).alias("h"), number.cast("bigint").alias("seq"), (key.isNull() | number.isNull()).alias("no_key"))
        saved = self.state(batch_no)
        n = rows.count() + expected
        if saved is None:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / self.keys_per_filter))
            capacity = int(n / parts * 1.2) + 2000
        else:
            first = saved.agg(F.max("parts").alias("p"), F.max("capacity").alias("c")).first()
            parts, capacity = first["p"], first["c"]
        lanes = mine.where("not no_key").select("h", "seq").mapInArrow(_answer_in_batch, "h bigint, seq bigint, answered boolean, lane bigint")
        work = lanes.select(F.pmod("lane", F.lit(parts)).cast("int").alias("part"), F.lit(-1).alias("layer"), "h", "seq", "answered")
        if saved is not None:
            # a filter is the first row of its partition
            work = work.unionByName(saved.select("part", "layer", "n_keys", "words"), allowMissingColumns=True)
        else:
            work = work.withColumns({"n_keys": F.lit(None).cast("bigint"), "words": F.lit(None).cast("binary")})
        work = work.select("part", "layer", "h", "seq", "answered", "n_keys", "words").repartitionById(parts, F.col("part"))
        work = work.sortWithinPartitions((F.col("layer") < 0), "layer", "seq", "h")
        out = work.mapInArrow(_decider(parts, capacity, self.target, -(-probes // parts)), ANSWERS)
        nulls = mine.where("no_key").select(F.lit("row").alias("kind"), "seq", F.lit(False).alias("seen"))
        target = f"{self.path}/batch={batch_no}"
        out.unionByName(nulls, allowMissingColumns=True).write.mode("overwrite").parquet(target)
        return spark.read.schema(ANSWERS).parquet(target)


def _decider(parts: int, capacity: int, target: float, more: int) -> Callable:
    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        layers, probes, false, missed, me = Layers(capacity, target), 0, 0, 0, None

        def give(n: int, **cols) -> pa.RecordBatch:
            types = {"kind": pa.string(), "seen": pa.bool_(), "part": pa.int32(), "parts": pa.int32(), "layer": pa.int32(), "words": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(cols[c], types.get(c, pa.int64())) if c in cols else pa.nulls(n, types.get(c, pa.int64())) for c in _NAMES], names=_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            me = batch.column(0)[0].as_py()
            layer = batch.column(1).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(layer >= 0):
                layers.load(int(layer[i]), batch.column(5)[int(i)].as_py(), batch.column(6)[int(i)].as_py())
            mine = np.flatnonzero(layer < 0)
            if not len(mine):
                continue
            rows = batch.take(pa.array(mine))
            h, seq = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            h, answered = h.astype(np.int64).view(np.uint64), rows.column(4).to_numpy(zero_copy_only=False).astype(bool)
            seen = answered.copy()
            ask = np.flatnonzero(~answered)
            if len(ask):
                hs = h[ask]
                hit = layers.query(hs)
                seen[ask] = hit | ~_first_of(hs)
                probes, false = probes + len(hs), false + int(layers.query(absent_twin(hs)).sum())
                new = np.unique(hs[~hit])
                if len(new):
                    layers.insert(new)
                missed += int((~layers.query(np.unique(hs))).sum())
            yield give(len(seq), kind=["row"] * len(seq), seq=seq.astype(np.int64), seen=seen)
        if me is not None:
            probes, false = probes + more, false + layers.false_yes(more, me)
            for i, (f, n) in enumerate(zip(layers.filters, layers.counts)):
                once = i == 0
                yield give(1, kind=["filter"], n_probes=[probes * once], n_false=[false * once], n_missed=[missed * once], part=[me], parts=[parts], layer=[i], capacity=[capacity], n_keys=[n], words=[f.words.tobytes()])

    return decide


def seen_before(rows: DataFrame, key: Column, number: str, history: DataFrame | None = None, history_key: Column | None = None, target: float = 1e-6, keys_per_filter: int = KEYS_PER_FILTER, path: str | None = None, probes: int = 0) -> DataFrame:
    """For each row of `rows` (unique long column `number` gives the order): was its key in `history` or an earlier row?

    The history is taken as batch 0 and the rows as batch 1 of the filters at `path` (default: a new one in the shared
    folder), which a further batch can go on from. Result: that of SeenFilters.take, seq under its own name.
    """
    spark = rows.sparkSession
    filters = SeenFilters(spark, path or f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}", target, keys_per_filter)
    if history is not None:
        filters.take(0, history, history_key, F.lit(0), expected=rows.count())
    return filters.take(1, rows, key, F.col(number), probes).withColumnRenamed("seq", number)


def poisson_upper(k: int, confidence: float = 0.95) -> float:
    """Largest mean under which k or fewer events still have a chance of 1 - confidence."""
    low, high = 0.0, 10.0 + 5 * k
    for _ in range(80):
        mid = (low + high) / 2
        term, total = math.exp(-mid), 0.0
        for i in range(k + 1):
            total += term
            term *= mid / (i + 1)
        low, high = (mid, high) if total > 1 - confidence else (low, mid)
    return high


def error_rate(answers: DataFrame, target: float) -> DataFrame:
    """One row: what the filters held, how often absent keys were answered with yes, and the rate that this excludes at 95 %
    (one-sided)."""
    f = answers.where("kind = 'filter'")
    sums = [F.sum(c).alias(c) for c in ("n_keys", "n_probes", "n_false", "n_missed")]
    one = f.agg(F.count(F.lit(1)).alias("n_filters"), *sums, F.sum(F.octet_length("words")).alias("filter_bytes")).first()
    upper = poisson_upper(one["n_false"]) / one["n_probes"] if one["n_probes"] else None
    rate = one["n_false"] / one["n_probes"] if one["n_probes"] else None
    schema = "n_filters bigint, n_keys bigint, n_probes bigint, n_false bigint, n_missed bigint, filter_bytes bigint, target_rate double, measured_rate double, upper_rate double"
    return answers.sparkSession.createDataFrame([(*one, target, rate, upper)], schema)
