"""Folds whose next state needs the last one: moving average of latencies, token bucket, last-N filter.

A key's rows are streamed in order through one state of constant size: rows are sorted by (key, seq) within
hash-partitioned tasks (the sort spills) and never gathered in a list. A fold over one key is sequential by its
definition; what can be done before it (here: the partial order, and column pruning) is done in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, out: list[T.StructField]) -> DataFrame:
    """df plus the columns `out`. step(state, columns) gets numpy arrays of consecutive rows of one key (in parts) and
    gives (new state, list of arrays); start() gives a key's first state."""
    schema = T.StructType([*df.schema.fields, *out])
    names = df.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = list(zip(*(batch.column(names.index(k)).to_pylist() for k in keys)))
            change = [0] + [i for i in range(1, len(ks)) if ks[i] != ks[i - 1]] + [len(ks)]
            parts: list[list] = [[] for _ in out]
            for a, b in zip(change, change[1:]):
                if state is None or ks[a] != now:
                    now, state = ks[a], start()
                cols = {n: batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i, n in enumerate(names) if n not in keys}
                state, got = step(state, cols)
                for p, g in zip(parts, got):
                    p.append(np.asarray(g))
            from pyspark.sql.pandas.types import to_arrow_type

            extra = [pa.array(np.concatenate(p), to_arrow_type(f.dataType)) for p, f in zip(parts, out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *[f.name for f in out]])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ema(df: DataFrame, keys: list[str], order: list[str], sample: str, name: str = "ema") -> DataFrame:
    """Integer moving average: the first sample, then (9 * state + sample) div 10; a state of 0 takes the sample.
    Null samples leave the state."""

    def step(state: int, cols: dict) -> tuple[int, list]:
        out = np.empty(len(cols[sample]), np.int64)
        for i, x in enumerate(cols[sample]):
            if x == x and x is not None:
                x = int(x)
                state = x if state == 0 else (state * 9 + x) // 10
            out[i] = state
        return state, [out]

    return ordered_fold(df, keys, order, lambda: 0, step, [T.StructField(name, T.LongType())])


def admitted(df: DataFrame, keys: list[str], order: list[str], sample: str, threshold: int = 50_000, latching: bool = True, name: str = "accepted") -> DataFrame:
    """Is a row accepted: is the moving average before it below the threshold? With `latching` a refused row gives no
    sample, so that once the average is over the threshold nothing is accepted any more; without it the average goes on
    and so may recover. Null samples leave the state."""

    def step(state: int, cols: dict) -> tuple[int, list]:
        out = np.empty(len(cols[sample]), bool)
        for i, x in enumerate(cols[sample]):
            out[i] = state < threshold
            if x == x and x is not None and (out[i] or not latching):
                x = int(x)
                state = x if state == 0 else (state * 9 + x) // 10
        return state, [out]

    return ordered_fold(df, keys, order, lambda: 0, step, [T.StructField(name, T.BooleanType())])


def token_bucket(df: DataFrame, keys: list[str], order: list[str], millis: str, rate: float, burst: float, name: str = "allowed") -> DataFrame:
    """Per key a bucket of `burst` tokens refilled at `rate` a second (never backwards in time); each row takes one or
    is refused (error 4290). Null times don't refill."""

    def step(state: tuple[float, float | None], cols: dict) -> tuple[tuple, list]:
        tokens, last = state
        out = np.empty(len(cols[millis]), bool)
        for i, t in enumerate(cols[millis]):
            if t is not None and t == t:
                if last is not None and t > last:
                    tokens = min(burst, tokens + (float(t) - last) * rate / 1000.0)
                last = float(t) if last is None else max(last, float(t))
            out[i] = tokens >= 1.0
            tokens -= out[i]
        return (tokens, last), [out]

    return ordered_fold(df, keys, order, lambda: (float(burst), None), step, [T.StructField(name, T.BooleanType())])


def last_ids(df: DataFrame, keys: list[str], order: list[str], ident: str, capacity: int = 10_000, name: str = "is_new", handled: str | None = None) -> DataFrame:
    """True where the id isn't among the key's last `capacity` accepted ids (first in, first out; a hit doesn't
    refresh). Null ids are new and aren't kept. An id is kept before its handler runs; with the boolean column `handled`
    only if the handler succeeded, so that a rejected event is new again when it is sent again."""
    from collections import OrderedDict

    def step(kept: OrderedDict, cols: dict) -> tuple[OrderedDict, list]:
        out = np.empty(len(cols[ident]), bool)
        for i, x in enumerate(cols[ident]):
            out[i] = x is None or x not in kept
            if out[i] and x is not None and (handled is None or cols[handled][i] is True or cols[handled][i] == True):  # noqa: E712
                if len(kept) >= capacity:
                    kept.popitem(last=False)
                kept[x] = None
        return kept, [out]

    return ordered_fold(df, keys, order, OrderedDict, step, [T.StructField(name, T.BooleanType())])


def micro_batches(df: DataFrame, keys: list[str], order: list[str], millis: str, most: int = 100, interval_ms: float = 5, name: str = "batch") -> DataFrame:
    """The number (from 0) of the batch a row is flushed with, per key: the first row of a batch starts its clock, and it is
    flushed once it holds `most` rows or the interval has passed. Rows without a time join the open batch."""

    def step(state: tuple[int, int, float], cols: dict) -> tuple[tuple, list]:
        number, held, began = state
        out = np.empty(len(cols[millis]), np.int64)
        for i, t in enumerate(cols[millis]):
            now = began if t is None or t != t else float(t)
            if held >= most or held and now > began + interval_ms:
                number, held = number + 1, 0
            if not held:
                began = now
            held += 1
            out[i] = number
        return (number, held, began), [out]

    return ordered_fold(df, keys, order, lambda: (0, 0, float("-inf")), step, [T.StructField(name, T.LongType())])
