"""Deeply nested request bodies as related flat tables.

Each body is parsed as a stream of tokens into path-value-ordinal triples in one pass, without a tree of the body; the
paths are grouped by their nearest repeated ancestor (an object that is an array element, or `data` itself), and each
group is pivoted into one table whose rows keep their own path and their parent's. A node's triples come from one body,
so the pivot happens in the task that parsed it and nothing is shuffled.

Defined results: a body that is null or no valid JSON (RFC 8259; NaN and the like are invalid) gives nothing; a body
that is no object gives nothing; of keys given twice the last counts; `data` that is a string holding a JSON object
counts as that object; numbers keep all their digits as written; depth isn't limited; halves of surrogate pairs, which
UTF-8 can't hold, become question marks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from json.encoder import encode_basestring, encode_basestring_ascii

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamroute.session import materialize

LINKS = ["request_id", "event_no", "node_path", "parent_path"]
TRIPLE = "request_id bigint, event_no int, topic string, grp string, node_path string, parent_path string, field string, kind string, value string, ordinal bigint"
NODE = "request_id bigint, event_no int, topic string, grp string, node_path string, parent_path string, node string, ordinal bigint, fields map<string,string>, kinds map<string,string>"

_BLANKS = r"[ \t\n\r]*"
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_SIMPLE = r'"[^"\\\x00-\x1f]*"'
#: One token; of a string only the quotation mark.
_TOKEN = re.compile(rf'{_BLANKS}(?:([{{}}\[\],:"])|({_NUMBER})|(true|false|null))')
#: A member with a plain key and a plain scalar, and the comma or end that follows it.
_MEMBER = re.compile(rf'{_BLANKS}({_SIMPLE}){_BLANKS}:{_BLANKS}(?:({_SIMPLE})|({_NUMBER})|(true|false|null)){_BLANKS}([,}}])')
_END = re.compile(rf"{_BLANKS}\Z")


class Number(str):
    """A number's text, exactly as it was written."""

    __slots__ = ()


class Repeated(Exception):
    """A key is given twice in one object."""


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=Number, parse_float=Number)
_WORDS = {"true": True, "false": False, "null": None}


def tokens(text: str, once: bool = True) -> Iterator[tuple]:
    """The JSON text as a stream of ('open', '{' or '['), ('key', name), ('value', scalar) and ('close', None), without
    recursion; numbers as Number. ValueError where it is no JSON; with `once`, Repeated where an object gives a key
    twice."""
    pos, token, member = 0, _TOKEN.match, _MEMBER.match
    stack: list[set | None] = []  # keys of open objects, None for arrays
    state = "value"  # value, first (value or end), key, first key (key or end), after
    while True:
        if state == "key" or state == "first key":
            if m := member(text, pos):
                key, string, number, word, end = m.groups()
                key = key[1:-1]
                if key in stack[-1] and once:
                    raise Repeated
                stack[-1].add(key)
                yield "key", key
                yield "value", string[1:-1] if string is not None else Number(number) if number is not None else _WORDS[word]
                pos = m.end()
                if end == ",":
                    state = "key"
                    continue
                stack.pop()
                yield "close", None
                state = "after"
            else:
                m = token(text, pos)
                if not m or m[1] not in ('"', "}") or m[1] == "}" and state == "key":
                    raise ValueError("key")
                pos = m.end()
                if m[1] == "}":
                    stack.pop()
                    yield "close", None
                    state = "after"
                else:
                    key, pos = scanstring(text, pos, True)
                    m = token(text, pos)
                    if not m or m[1] != ":":
                        raise ValueError("colon")
                    if key in stack[-1] and once:
                        raise Repeated
                    stack[-1].add(key)
                    yield "key", key
                    pos, state = m.end(), "value"
                    continue
        elif state == "value" or state == "first":
            m = token(text, pos)
            if not m:
                raise ValueError("value")
            sign, number, word = m.groups()
            pos = m.end()
            if sign == "{":
                stack.append(set())
                yield "open", sign
                state = "first key"
                continue
            if sign == "[":
                stack.append(None)
                yield "open", sign
                state = "first"
                continue
            if sign == "]" and state == "first":
                stack.pop()
                yield "close", None
            elif sign == '"':
                value, pos = scanstring(text, pos, True)
                yield "value", value
            elif sign is None:
                yield "value", Number(number) if number is not None else _WORDS[word]
            else:
                raise ValueError("value")
            state = "after"
        if not stack:
            if not _END.match(text, pos):
                raise ValueError("text after the value")
            return
        m = token(text, pos)
        if not m:
            raise ValueError("comma or end")
        pos, sign = m.end(), m[1]
        if sign == ",":
            state = "value" if stack[-1] is None else "key"
        elif sign == ("]" if stack[-1] is None else "}"):
            stack.pop()
            yield "close", None
        else:
            raise ValueError("comma or end")


def _tree(stream: Iterator[tuple]):
    """The value that a stream of tokens spells; of keys given twice the last counts."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    for kind, x in stream:
        if kind == "key":
            keys[-1] = x
            continue
        if kind == "close":
            stack.pop()
            keys.pop()
            continue
        new = x if kind == "value" else {} if x == "{" else []
        if isinstance(stack[-1], list):
            stack[-1].append(new)
        else:
            stack[-1][keys[-1]] = new
        if kind == "open":
            stack.append(new)
            keys.append(None)
    return root[0]


def _spelled(value) -> Iterator[tuple]:
    """The tokens of a value."""
    stack: list[tuple] = [("any", value)]
    while stack:
        kind, v = stack.pop()
        if kind != "any":
            yield kind, v
        elif isinstance(v, dict):
            yield "open", "{"
            stack.append(("close", None))
            for k, x in reversed(v.items()):
                stack += [("any", x), ("key", k)]
        elif isinstance(v, list):
            yield "open", "["
            stack.append(("close", None))
            stack += [("any", x) for x in reversed(v)]
        else:
            yield "value", v


def parse(text: str | None):
    """The value of a JSON text (numbers as Number); ValueError if it is none."""
    if text is None:
        raise ValueError("null")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _tree(tokens(text, once=False))


def _quoted(s: str) -> str:
    if s.isascii():
        return encode_basestring(s)
    try:
        s.encode()
    except UnicodeEncodeError:  # half a surrogate pair: escaped, it stays valid JSON
        return encode_basestring_ascii(s)
    return encode_basestring(s)


def dumps(value) -> str:
    """JSON text of a parsed value: numbers as they were written, no recursion, always valid UTF-8."""
    out: list[str] = []
    stack: list[tuple] = [(False, value)]
    while stack:
        done, v = stack.pop()
        if done or type(v) is Number:
            out.append(v)
        elif isinstance(v, str):
            out.append(_quoted(v))
        elif isinstance(v, dict):
            stack.append((True, "}" if v else "{}"))
            items = list(v.items())
            for i in range(len(items) - 1, -1, -1):
                stack += [(False, items[i][1]), (True, ("," if i else "{") + _quoted(items[i][0]) + ":")]
        elif isinstance(v, list):
            stack.append((True, "]" if v else "[]"))
            for i in range(len(v) - 1, -1, -1):
                stack += [(False, v[i]), (True, "," if i else "[")]
        else:
            out.append(json.dumps(v, allow_nan=False))
    return "".join(out)


def events_of(body: str | None) -> list[tuple[int, str | None, object, object]]:
    """(event_no, topic, data, headers) of a body's publish requests as trees; [] where there are none."""
    try:
        top = parse(body)
    except ValueError:
        return []
    if not isinstance(top, dict):
        return []
    several = top.get("events")
    out = []
    for i, e in enumerate(several if isinstance(several, list) else [top]):
        if not isinstance(e, dict):
            continue
        data, topic = e.get("data"), e.get("topic")
        if type(data) is str and "{" in data:
            try:
                inner = parse(data)
            except ValueError:
                inner = None
            if isinstance(inner, dict):
                data = inner
        out.append((i, topic if type(topic) is str else None, data, e.get("headers")))
    return out


def kind_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return "string" if type(v) is str else "number"


def text_of(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return ("true" if v else "false") if isinstance(v, bool) else json.dumps(v)


class Event:
    """What the stream of one publish request has given: rows of (group, node path, parent path, field, kind, value)."""

    __slots__ = ("no", "topic", "data", "headers")

    def __init__(self, no: int):
        self.no, self.topic = no, None
        self.data: list[tuple] = []
        self.headers: list[tuple] = []


_BODY, _EVENTS, _EVENT, _DATA, _HEADERS, _SKIP, _KEEP = range(7)
_ROOT = ("data", "data", "data")


def _data_rows(text: str) -> list[tuple] | None:
    """Rows of a text that holds a JSON object; None if it holds none."""
    event = Event(0)
    for once in (True, False):
        try:
            stream = tokens(text) if once else _spelled(_tree(tokens(text, once=False)))
            if next(stream) != ("open", "{"):
                return None
            event.data = [(*_ROOT, "", "root", None)]
            _walk(stream, [[_DATA, False, 0, "data", "data", _ROOT, "", event]], [])
            return event.data
        except Repeated:
            continue
        except ValueError:
            return None
    return None


def _walk(stream: Iterator[tuple], frames: list[list], batch: list[Event]) -> bool:
    """Turn tokens into rows of their events. A frame: role, is it an array, its next index, general path, exact path, the
    node it belongs to, the field's prefix in that node, its event or kept value. True if the body was a batch.

    Scalars belong to their nearest array-element object or to `data`; scalars that are array elements make a repeated
    group of their own, whose node is the element and whose field is ''. Kinds 'root', 'object' and 'header' stand for
    the nodes themselves.
    """
    key, is_batch = None, False
    for kind, x in stream:
        if kind == "key":
            key = x
            continue
        top = frames[-1]
        if kind == "close":
            frames.pop()
            if top[0] == _KEEP and top[6]:
                top[7].headers.append(("headers", f"headers.{top[6]}", "headers", "value", "json", dumps(top[5])))
            continue
        role = top[0]
        if role == _DATA:
            node, field = top[5], top[6]
            if top[1]:
                i = top[2]
                top[2] = i + 1
                general, exact, field = top[3] + "[]", f"{top[4]}[{i}]", field + "[]"
            else:
                general, exact, field = f"{top[3]}.{key}", f"{top[4]}.{key}", f"{field}.{key}" if field else key
            if kind == "value":
                if top[1]:
                    top[7].data.append((general, exact, node[1], "", kind_of(x), text_of(x)))
                else:
                    top[7].data.append((*node, field, kind_of(x), text_of(x)))
                continue
            if x == "{" and top[1]:
                node, field = (general, exact, node[1]), ""
                top[7].data.append((*node, "", "object", None))
            frames.append([_DATA, x == "[", 0, general, exact, node, field, top[7]])
            continue
        if role == _KEEP:
            new = x if kind == "value" else {} if x == "{" else []
            if top[1]:
                top[5].append(new)
            else:
                top[5][key] = new
            if kind == "open":
                frames.append([_KEEP, x == "[", 0, "", "", new, "", None])
            continue
        if role == _HEADERS:
            event = top[7]
            event.headers.append(("headers", f"headers.{key}", "headers", "name", "header", key))
            if kind == "value":
                event.headers.append(("headers", f"headers.{key}", "headers", "value", kind_of(x), text_of(x)))
            else:
                frames.append([_KEEP, x == "[", 0, "", "", {} if x == "{" else [], key or "", event])
            continue
        if role == _EVENTS:
            i = top[2]
            top[2] = i + 1
            if kind == "open":
                if x == "{":
                    batch.append(Event(i))
                    frames.append([_EVENT, False, 0, "", "", None, "", batch[-1]])
                else:
                    frames.append([_SKIP, True, 0, "", "", None, "", None])
            continue
        if role == _BODY and key == "events" and kind == "open" and x == "[":
            is_batch = True
            frames.append([_EVENTS, True, 0, "", "", None, "", None])
        elif role in (_BODY, _EVENT) and key == "data":
            event = top[7]
            if kind == "open":
                event.data.append((*_ROOT, "", "root", None))
                frames.append([_DATA, x == "[", 0, "data", "data", _ROOT, "", event])
            elif x is not None:
                rows = _data_rows(x) if type(x) is str and "{" in x else None
                event.data += rows or [(*_ROOT, "", kind_of(x), text_of(x))]
        elif role in (_BODY, _EVENT) and key == "headers" and kind == "open" and x == "{":
            frames.append([_HEADERS, False, 0, "", "", None, "", top[7]])
        elif role in (_BODY, _EVENT) and key == "topic" and kind == "value":
            top[7].topic = x if type(x) is str else None
        elif kind == "open":
            frames.append([_SKIP, x == "[", 0, "", "", None, "", None])
    return is_batch


def stream_events(body: str | None) -> list[Event]:
    """The publish requests of a body with their rows; [] where there are none."""
    if body is None:
        return []
    for once in (True, False):
        try:
            stream = tokens(body) if once else _spelled(_tree(tokens(body, once=False)))
            if next(stream) != ("open", "{"):
                return []
            single, batch = Event(0), []
            is_batch = _walk(stream, [[_BODY, False, 0, "", "", None, "", single]], batch)
            return batch if is_batch else [single]
        except Repeated:
            continue
        except ValueError:
            return []
    return []


#: Rows a task gathers before it hands a batch on.
BATCH_ROWS = 100_000


def triples(requests: DataFrame) -> DataFrame:
    """Triples of every valid body (columns request_id and body): see TRIPLE. A narrow Arrow map."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), *[pa.string()] * 7, pa.int64()]
        names = [c.split()[0] for c in TRIPLE.split(", ")]
        cols: list[list] = [[] for _ in names]
        for batch in batches:
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for e in stream_events(body):
                    rows = e.data + e.headers
                    for ordinal, row in enumerate(rows):
                        for c, x in zip(cols, (rid, e.no, e.topic, *row, ordinal)):
                            c.append(x)
                if len(cols[0]) > BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([_array(c, t) for c, t in zip(cols, types)], names=names)
                    cols = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([_array(c, t) for c, t in zip(cols, types)], names=names)

    return requests.select("request_id", "body").mapInArrow(run, TRIPLE)


def nodes(requests: DataFrame) -> DataFrame:
    """The triples of every valid body pivoted to a row a node: see NODE. node: root, object, header, or element for
    scalars that are array elements; ordinal: the node's place in its event; fields and kinds: its scalars by their
    path in the node ('' for an element's own value; a path that comes again, as a key `a.b` beside a's b, gets #2) as
    texts and their kinds.

    All triples of a node stand in one body, so a task pivots them as it parses; nothing is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int64()]
        names = [c.split()[0] for c in NODE.split(", ")]

        def new() -> tuple:
            return [[] for _ in types], [0], [], [], []

        def give(cols, offsets, keys, values, kinds) -> pa.RecordBatch:
            off, k = pa.array(offsets, pa.int32()), _array(keys, pa.string())
            maps = [pa.MapArray.from_arrays(off, k, _array(x, pa.string())) for x in (values, kinds)]
            return pa.RecordBatch.from_arrays([*(_array(c, t) for c, t in zip(cols, types)), *maps], names=names)

        cols, offsets, keys, values, kinds = new()
        rid_c, no_c, topic_c, grp_c, path_c, parent_c, node_c, ord_c = cols
        for batch in batches:
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for e in stream_events(body):
                    found: dict[str, list] = {}
                    for grp, path, parent, field, kind, value in e.data + e.headers:
                        if (at := found.get(path)) is None:
                            found[path] = at = [grp, parent, kind if kind in _NODE_KINDS else "root" if path == "data" else "element", [], [], []]
                        if kind not in _NODE_KINDS or kind == "header":
                            at[3].append(field)
                            at[4].append(value)
                            at[5].append(kind if kind != "header" else "string")
                    for i, (path, (grp, parent, node, ks, vs, ts)) in enumerate(found.items()):
                        if len(ks) > 1 and len(set(ks)) < len(ks):
                            ks = _apart(ks)
                        rid_c.append(rid)
                        no_c.append(e.no)
                        topic_c.append(e.topic)
                        grp_c.append(grp)
                        path_c.append(path)
                        parent_c.append(parent)
                        node_c.append(node)
                        ord_c.append(i)
                        keys += ks
                        values += vs
                        kinds += ts
                        offsets.append(len(keys))
                if len(rid_c) > BATCH_ROWS // 4:
                    yield give(cols, offsets, keys, values, kinds)
                    cols, offsets, keys, values, kinds = new()
                    rid_c, no_c, topic_c, grp_c, path_c, parent_c, node_c, ord_c = cols
        yield give(cols, offsets, keys, values, kinds)

    return requests.select("request_id", "body").mapInArrow(run, NODE)


_NODE_KINDS = {"root", "object", "header"}


def _apart(fields: list[str]) -> list[str]:
    """Fields of one node, a path that comes again (a key `a.b` beside a's b) with its number added."""
    out: dict[str, None] = {}
    for f in fields:
        name, i = f, 1
        while name in out:
            i += 1
            name = f"{f}#{i}"
        out[name] = None
    return list(out)


def _array(values: list, kind):
    """Lone surrogates from JSON escapes can't be UTF-8; they become question marks."""
    import pyarrow as pa

    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in values], kind)


def node_links(rows: DataFrame) -> DataFrame:
    """One row per repeated object and per header, with its parent's path."""
    return rows.where("node in ('object', 'header')").select(*LINKS)


def groups(rows: DataFrame) -> DataFrame:
    """What tables there are: group, field, kinds seen and numbers of values."""
    each = rows.select("grp", F.explode("kinds").alias("field", "kind"))
    return each.groupBy("grp", "field").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("string", "number", "boolean", "null")])


def column_names(fields: list[str]) -> dict[str, str]:
    """A column name for each field, different ones for different fields whatever the case. A field that is a plain
    lower-case name keeps it; dots, brackets and the like become underscores, and where two fields would get the same
    name, or that of a link column, the end of a digest of the field is added."""
    import hashlib

    simple = {f: (re.sub(r"\W", "_", f) or "value").lower() for f in fields}
    taken = set(LINKS)
    out = {}
    for f in sorted(fields, key=lambda f: (simple[f] != f, f)):
        name = simple[f]
        if name in taken or sum(s == name for s in simple.values()) > 1 and name != f:
            name = f"{name}_{hashlib.sha256(f.encode('utf-8', 'replace')).hexdigest()[:12]}"
        taken.add(name)
        out[f] = name
    return out


def pivot_group(rows: DataFrame, grp: str, fields: list[str]) -> DataFrame:
    """One group's table: a row a node with its links and a string column a field, named by column_names."""
    names = column_names(fields)
    value: Column = F.col("fields")
    return rows.where(F.col("grp") == grp).select(*LINKS, *[F.try_element_at(value, F.lit(f)).alias(names[f]) for f in fields])


class Tables:
    """The flat tables of a set of bodies. tables: by group; fields: the fields of each (in the order of their columns);
    rest: the nodes of all groups that would make more tables or columns than asked for, their scalars as maps."""

    def __init__(self, tables: dict[str, DataFrame], fields: dict[str, list[str]], rest: DataFrame):
        self.tables, self.fields, self.rest = tables, fields, rest


#: Files a task's nodes are split into by group.
GROUP_BUCKETS = 16


def flat_tables(requests: DataFrame, max_groups: int = 200, max_fields: int = 500) -> Tables:
    """All tables of the bodies.

    Parsed once; the nodes are kept in the shared folder, split by group and sorted by it, so that reading one table
    reads few row groups of the others. The lists of groups and fields (the schema, not data) come to the driver, as far
    as the bounds go. Where keys are data (ids as names) there may be more: such groups lose nothing, their nodes are in
    `rest`.
    """
    bucket = F.pmod(F.xxhash64("grp"), F.lit(GROUP_BUCKETS)).cast("int").alias("bucket")
    kept = materialize(nodes(requests).select("*", bucket).sortWithinPartitions("bucket", "grp"), "nodes", ["bucket"])
    seen = kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    wide = kept.select("grp", F.explode(F.map_keys("fields")).alias("field")).distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n_fields"), F.slice(F.array_sort(F.collect_list("field")), 1, max_fields).alias("fields"))
    wide = seen.join(wide, "grp", "left").where(F.coalesce("n_fields", F.lit(0)) <= max_fields).orderBy(F.col("n").desc(), "grp").limit(max_groups)
    chosen = {r["grp"]: list(r["fields"] or []) for r in wide.select("grp", "fields").collect()}
    buckets = {r["grp"]: r["bucket"] for r in kept.sparkSession.createDataFrame([(g,) for g in chosen] or [], "grp string").select("grp", bucket).collect()}
    tables = {g: pivot_group(kept.where(F.col("bucket") == buckets[g]), g, fs) for g, fs in chosen.items()}
    rest = kept.where(~F.col("grp").isin(*chosen)) if chosen else kept
    return Tables(tables, chosen, rest.drop("bucket"))


def table_profiles(tables: Tables) -> DataFrame:
    """Per table and field: rows, values and characters of the values; '' stands for fields of `rest`."""
    out = None
    for g, t in tables.tables.items():
        names = column_names(tables.fields[g])
        each = [F.struct(F.lit(f).alias("field"), F.col(f"`{names[f]}`").alias("v")) for f in tables.fields[g]] or [F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("v"))]
        cells = t.select(F.lit(g).alias("grp"), F.explode(F.array(*each)).alias("c")).select("grp", "c.field", "c.v")
        out = cells if out is None else out.unionByName(cells)
    more = tables.rest.select("grp", F.explode_outer("fields").alias("field", "v"))
    out = more if out is None else out.unionByName(more)
    return out.groupBy("grp", "field").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_values"), F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("n_chars"))
