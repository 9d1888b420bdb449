"""Log segments and captured frames as DataFrames, and their writers for tests and migrations.

A segment file is one partition. A replay reads it until its end, a truncated tail or the first corrupt record;
corruption stops that segment only.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from streamroute.sources.crc32c import crc32c, crc32c_many
from streamroute.sources.msgpack import pack, to_json_value, unpack

# fixed values of the file formats
SEGMENT_MAGIC, FRAME_MAGIC, VERSION = b"PLWL", b"\x50\x4c", 1
SEGMENT_HEADER = struct.Struct(">4sBIQ15x")
RECORD_HEAD = struct.Struct(">IB16s")
FRAME_HEAD = struct.Struct(">2sBBB16sI")
RECORD_LEAST = 25
RECORD_TYPES = {1: "event_write", 2: "completion"}
FRAME_TYPES = {1: "connect", 2: "connack", 3: "pub", 4: "ack", 5: "sub", 6: "unsub", 7: "ping", 8: "pong", 9: "flow", 10: "err"}
MAX_PAYLOAD = 1 << 20


def encode_header(segment: int, created_ms: int) -> bytes:
    return SEGMENT_HEADER.pack(SEGMENT_MAGIC, VERSION, segment, created_ms)


def encode_record(rec_type: int, msg_id: bytes, data: bytes) -> bytes:
    body = RECORD_HEAD.pack(RECORD_LEAST + len(data), rec_type, msg_id) + data
    return body + struct.pack(">I", crc32c(body))


def encode_frame(frame_type: int, flags: int, msg_id: bytes, payload: bytes) -> bytes:
    body = FRAME_HEAD.pack(FRAME_MAGIC, VERSION, frame_type, flags & 0x0F, msg_id, len(payload)) + payload
    return body + struct.pack(">I", crc32c(body))


@dataclass
class Scan:
    """What reading a segment gave: records (offset, length, type, id, data) and where and why it stopped."""

    segment: int | None
    records: list[tuple[int, int, str, str, bytes]]
    stopped_at: int
    why: str  # end, truncated, corrupt, header


def scan_segment(data: bytes) -> Scan:
    if len(data) < SEGMENT_HEADER.size:
        return Scan(None, [], 0, "header")
    magic, version, segment, _ = SEGMENT_HEADER.unpack_from(data)
    if magic != SEGMENT_MAGIC or version != VERSION:
        return Scan(None, [], 0, "header")
    at, heads, why = SEGMENT_HEADER.size, [], "end"
    while at < len(data):
        left = len(data) - at
        size = struct.unpack_from(">I", data, at)[0] if left >= 4 else RECORD_LEAST
        if size < RECORD_LEAST or size > left:
            why = "corrupt" if size < RECORD_LEAST else "truncated"
            break
        heads.append((at, size))
        at += size
    # lengths first, then all checksums at once; what follows a bad one isn't trusted
    sums = crc32c_many([data[a : a + n - 4] for a, n in heads])
    records = []
    for (a, n), crc in zip(heads, sums.tolist()):
        _, kind, ident = RECORD_HEAD.unpack_from(data, a)
        if struct.unpack_from(">I", data, a + n - 4)[0] != crc or kind not in RECORD_TYPES:
            return Scan(segment, records, a, "corrupt")
        records.append((a, n, RECORD_TYPES[kind], ident.hex(), bytes(data[a + RECORD_HEAD.size : a + n - 4])))
    return Scan(segment, records, at, why)


def scan_frames(data: bytes, max_payload: int = MAX_PAYLOAD) -> Iterator[tuple[int, str, int, str, bytes, str]]:
    """(offset, type, flags, id, payload, error) of the frames of a captured byte stream. A broken frame is given with
    its error code and ends the stream; an incomplete last frame is waited for, that is, not given."""
    at = 0
    while len(data) - at >= FRAME_HEAD.size:
        magic, version, kind, flags, ident, size = FRAME_HEAD.unpack_from(data, at)
        if magic != FRAME_MAGIC or version != VERSION or kind not in FRAME_TYPES:
            yield at, FRAME_TYPES.get(kind, "?"), flags & 0x0F, ident.hex(), b"", "4000"
            return
        if size > max_payload:
            yield at, FRAME_TYPES[kind], flags & 0x0F, ident.hex(), b"", "4090"
            return
        end = at + FRAME_HEAD.size + size
        if end + 4 > len(data):
            return
        if struct.unpack_from(">I", data, end)[0] != crc32c(data[at:end]):
            yield at, FRAME_TYPES[kind], flags & 0x0F, ident.hex(), b"", "4001"
            return
        yield at, FRAME_TYPES[kind], flags & 0x0F, ident.hex(), data[at + FRAME_HEAD.size : end], ""
        at = end + 4


def payload_json(data: bytes) -> str | None:
    """MessagePack payload as JSON text, null if it is none."""
    try:
        return json.dumps(to_json_value(unpack(data)), ensure_ascii=False)
    except (ValueError, RecursionError, struct.error):
        return None


def packed(text: Column) -> Column:
    """JSON text as MessagePack bytes, null where it is none or holds an integer that has no such form."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bytes | None:
            try:
                return None if t is None else pack(json.loads(t))
            except (ValueError, RecursionError, UnicodeEncodeError):
                return None

        return texts.map(one)

    return run(text)


def unpacked(data: Column) -> Column:
    """MessagePack bytes as JSON text (payload_json)."""
    @F.pandas_udf("string")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else payload_json(bytes(b)))

    return run(data)


def frames_of(messages: DataFrame, name: Column, order: str) -> DataFrame:
    """Messages (frame_type, flags, msg_id as hex digits, payload binary) as captured byte streams: name, content, its frames
    by `order`. The messages of one stream go to one task, as a connection's do."""
    codes = {v: k for k, v in FRAME_TYPES.items()}

    def run(pdf):
        rows = pdf.sort_values("o")
        body = b"".join(encode_frame(codes[t], f, bytes.fromhex(i), bytes(p)) for t, f, i, p in zip(rows["frame_type"], rows["flags"], rows["msg_id"], rows["payload"]))
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "content": [body]})

    slim = messages.select(name.cast("string").alias("name"), F.col(order).alias("o"), "frame_type", F.col("flags").cast("int").alias("flags"), "msg_id", "payload")
    return slim.where("name is not null and msg_id is not null and payload is not null").groupBy("name").applyInPandas(run, "name string, content binary")


@dataclass
class _Segment(InputPartition):
    path: str
    shard: int
    segment: int


class WalSource(DataSource):
    """spark.read.format('streamroute_wal').load(dir): records of dir/shard-NN/segment-NNNNNN.wal, a task a segment."""

    @classmethod
    def name(cls) -> str:
        return "streamroute_wal"

    def schema(self) -> str:
        return "shard int, segment int, wal_offset bigint, rec_len int, rec_type string, msg_id string, consumer_id string, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return WalReader(self.options.get("path", ""))


def file_system(path: str) -> tuple:
    """(file system, path) of a URI or a local path, by Arrow: local, HDFS and the object stores it knows."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^file:", "", path))


_SEGMENT = re.compile(r"shard-(\d+)/segment-(\d+)\.wal\Z")


class WalReader(DataSourceReader):
    def __init__(self, path: str):
        self.root = re.sub(r"^file:/(?!//)", "file:///", path)

    def partitions(self) -> list[_Segment]:
        from pyarrow.fs import FileSelector

        fs, root = file_system(self.root)
        found = sorted(f.path for f in fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)))
        return [_Segment(p, int(m[1]), int(m[2])) for p in found if (m := _SEGMENT.search(p))] or [_Segment("", 0, 0)]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        if not partition.path:
            return
        with file_system(self.root)[0].open_input_file(partition.path) as f:
            scan = scan_segment(f.read())
        for at, size, kind, ident, data in scan.records:
            done = kind == "completion"
            yield partition.shard, partition.segment, at, size, kind, ident, data.decode("utf-8", "replace") if done else None, None if done else data


def read_wal_files(files: DataFrame) -> DataFrame:
    """Records from a `binaryFile` DataFrame (path, content), for any file system Spark can read: shard and segment
    come from the path."""
    schema = WalSource({}).schema()

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                m = re.search(r"shard-(\d+)/segment-(\d+)\.wal\Z", path)
                shard, segment = (int(m[1]), int(m[2])) if m else (None, None)
                for at, size, kind, ident, data in scan_segment(bytes(content)).records:
                    done = kind == "completion"
                    rows.append((shard, segment, at, size, kind, ident, data.decode("utf-8", "replace") if done else None, None if done else data))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


def read_frames(captures: DataFrame, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """Frames of captured byte streams (columns name and content): name, frame_offset, frame_type, flags, msg_id, payload
    and code (the error of a broken frame, after which its stream isn't read on)."""
    schema = "name string, frame_offset bigint, frame_type string, flags int, msg_id string, payload binary, code string"

    def run(batches):
        for pdf in batches:
            rows = [(n, *f) for n, c in zip(pdf["name"], pdf["content"]) if c is not None for f in scan_frames(bytes(c), max_payload)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return captures.select(F.col("name").cast("string"), "content").mapInPandas(run, schema)


def write_segment(root: str, shard: int, segment: int, records: list[tuple[int, bytes, bytes]], created_ms: int = 0) -> str:
    """A segment file from (type, id, data); returns its path. It appears whole, by a rename."""
    return _put(root, shard, segment, encode_header(segment, created_ms) + b"".join(encode_record(*r) for r in records))


def _put(root: str, shard: int, segment: int, content: bytes) -> str:
    fs, at = file_system(root)
    folder = f"{at.rstrip('/')}/shard-{shard:02d}"
    path = f"{folder}/segment-{segment:06d}.wal"
    fs.create_dir(folder, recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, path)
    return path


WRITTEN = "shard int, segment int, n_records bigint, n_bytes bigint"


def write_log(records: DataFrame, root: str, segment_bytes: int = 64 << 20, first: int = 1) -> DataFrame:
    """Append records (shard int, seq bigint, rec_type, msg_id as hex digits, data binary) to the shards' logs: a shard in
    the order of seq by one task, a new segment where the next record wouldn't fit. Gives the segments written; calling
    an action on it writes them, and again the same ones if a task is repeated. `first`: number of the first segment."""
    codes, head = {v: k for k, v in RECORD_TYPES.items()}, SEGMENT_HEADER.size

    def run(batches):
        done, shard, number, buffer, size, n = [], None, first, [], 0, 0

        def close() -> None:
            if buffer:
                _put(root, shard, number, encode_header(number, 0) + b"".join(buffer))
                done.append((shard, number, n, size))

        for pdf in batches:
            for s, kind, ident, data in zip(pdf["shard"], pdf["rec_type"], pdf["msg_id"], pdf["data"]):
                record = encode_record(codes[kind], bytes.fromhex(ident), bytes(data))
                fresh = s != shard
                if fresh or size + len(record) > segment_bytes:
                    close()
                    number, buffer, size, n = (first if fresh else number + 1), [], head, 0
                    shard = int(s)
                buffer.append(record)
                size, n = size + len(record), n + 1
        close()
        yield pd.DataFrame(done, columns=["shard", "segment", "n_records", "n_bytes"])

    rows = records.where("shard is not null and msg_id is not null and data is not null").select("shard", "seq", "rec_type", "msg_id", "data")
    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, WRITTEN)


def with_shard(events: DataFrame, shards: int, topic: str = "topic") -> DataFrame:
    """events plus the shard of their topic (stable hash modulo the number of shards; null topics go to shard 0)."""
    from streamroute.operators.groups import stable_hash

    return events.withColumn("shard", F.coalesce(F.pmod(stable_hash(F.col(topic)), F.lit(shards)), F.lit(0)).cast("int"))
