"""Bodies posted to the gateway as events with a status per publish."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from streamroute.operators.nested import _array, dumps, events_of, parse, text_of

PUBLISHED = "request_id bigint, event_no int, topic string, data string, headers map<string,string>, status string"


def publishes(requests: DataFrame) -> DataFrame:
    """Every event of every body with `data` as JSON text: status 'stored', or 'error 4000' for bodies that are no
    valid request (event_no null) and for events without a topic. A batch isn't atomic."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        names = [c.split()[0] for c in ("request_id x", "event_no x", "topic x", "data x", "headers x", "status x")]
        for batch in batches:
            rows = []
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    ok = isinstance(parse(body), dict)
                except ValueError:
                    ok = False
                if not ok:
                    rows.append((rid, None, None, None, [], "error 4000"))
                for no, topic, data, headers in events_of(body) if ok else []:
                    pairs = [(k, text_of(v) if not isinstance(v, (dict, list)) else dumps(v)) for k, v in headers.items()] if isinstance(headers, dict) else []
                    rows.append((rid, no, topic, dumps(data), pairs, "stored" if topic else "error 4000"))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) if pa.types.is_map(t) else _array(list(c), t) for c, t in zip(cols, types)], names=names)

    return requests.select("request_id", "body").mapInArrow(run, PUBLISHED)
