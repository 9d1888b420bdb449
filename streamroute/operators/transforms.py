"""Declarative payload transforms: set, remove, rename, copy and default, in order, on a copy of the payload.

For payloads with a declared struct type the operations become native struct expressions; for dynamic payloads (JSON
text) one Arrow-batched pass applies the whole list. What it gives is always valid JSON: numbers keep their digits as
written (1e999 and the like too), halves of surrogate pairs stay escaped. Texts that are no JSON (NaN and Infinity are
none) come out as they are.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamroute.operators.nested import _spelled, _tree, dumps, parse, text_of

#: First part of paths into the headers instead of the payload.
HEADERS = "\0headers"


@dataclass(frozen=True)
class Op:
    """kind: set, remove, rename, copy or default. path: where; to: target of rename and copy; value: JSON-like."""

    kind: str
    path: tuple[str, ...]
    value: object = None
    to: tuple[str, ...] = ()


_SET = re.compile(r"\s*([\w.]+)\s*=\s*(.+?)\s*\Z", re.S)
_MOVE = re.compile(r"\s*([\w.]+)\s*->\s*([\w.]+)\s*\Z")


def op(kind: str, text: str, root_alias: str = "payload") -> Op:
    """Text form: ``set``/``default`` take ``path = value`` (JSON or a single-quoted string), ``rename``/``copy`` take
    ``a -> b``, ``remove`` takes ``path``. A leading ``payload.`` is stripped; a leading ``headers.`` means the headers
    where there are any, else the payload's field of that name."""

    def path(s: str) -> tuple[str, ...]:
        parts = tuple(s.split("."))
        if len(parts) > 1 and parts[0] == "headers":
            return (HEADERS, *parts[1:])
        return parts[1:] if len(parts) > 1 and parts[0] == root_alias else parts

    if kind in ("set", "default"):
        if not (m := _SET.match(text)):
            raise ValueError(f"expected path = value: {text}")
        raw = m[2]
        value = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] == "'" else json.loads(raw)
        json.dumps(value, allow_nan=False)  # an error here rather than in every row
        return Op(kind, path(m[1]), value)
    if kind in ("rename", "copy"):
        if not (m := _MOVE.match(text)):
            raise ValueError(f"expected a -> b: {text}")
        return Op(kind, path(m[1]), to=path(m[2]))
    if kind == "remove":
        return Op(kind, path(text.strip()))
    raise ValueError(f"unknown operation {kind}")


# dynamic payloads ------------------------------------------------------------------------------------------------

_NONE = object()


def _parent(data: object, path: tuple[str, ...], make: bool = False) -> dict | None:
    """The map that holds the path's last part, None where something on the way is no map."""
    for part in path[:-1]:
        if not isinstance(data, dict):
            return None
        if part not in data:
            if not make:
                return None
            data[part] = {}
        data = data[part]
    return data if isinstance(data, dict) else None


def _get(data: object, path: tuple[str, ...]) -> object:
    at = _parent(data, path)
    return at.get(path[-1], _NONE) if at is not None and path else _NONE


def _put(data: object, path: tuple[str, ...], value: object) -> None:
    if path and (at := _parent(data, path, make=True)) is not None:
        at[path[-1]] = value


def _plain(path: tuple[str, ...]) -> tuple[str, ...]:
    return ("headers", *path[1:]) if path and path[0] == HEADERS else path


def apply_ops(data: object, ops: list[Op], headers: dict | None = None) -> object:
    """Apply to a Python value in place (the caller hands in a copy). headers: the map that paths into the headers mean."""

    def at(path: tuple[str, ...]) -> tuple[object, tuple[str, ...]]:
        if path and path[0] == HEADERS and headers is not None:
            return headers, (".".join(path[1:]),)
        return data, _plain(path)

    for o in ops:
        root, path = at(o.path)
        if o.kind == "set" or o.kind == "default" and _get(root, path) is _NONE:
            _put(root, path, _tree(_spelled(o.value)))
        elif o.kind == "remove" and (holder := _parent(root, path)) is not None:
            holder.pop(path[-1], None)
        elif o.kind in ("rename", "copy") and (v := _get(root, path)) is not _NONE:
            if o.kind == "rename":
                _parent(root, path).pop(path[-1])
            _put(*at(o.to), _tree(_spelled(v)))
    return data


def transformed(text: str | None, ops: list[Op], headers: list | None = None) -> tuple[str | None, list | None]:
    """A payload's JSON text and its headers (pairs) after the operations; null and invalid payloads, and their headers,
    as they were."""
    if text is None or not ops:
        return text, headers
    try:
        data = parse(text)
    except ValueError:
        return text, headers
    top = None if headers is None else dict(headers)
    out = dumps(apply_ops(data, ops, top))
    return out, None if top is None else [(k, dumps(v) if isinstance(v, (dict, list)) else text_of(v)) for k, v in top.items()]


def transform_json(payload: Column, ops: list[Op]) -> Column:
    """JSON text in, JSON text out; null and invalid payloads come out as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: transformed(t, ops)[0], na_action="ignore")

    return run(payload)


# struct payloads -------------------------------------------------------------------------------------------------


class StructPayload:
    """A struct payload under transformation: a tree of Columns. A field that is a SQL null is taken as present unless
    nulls_missing; a missing field is one the type doesn't have (or a null one with nulls_missing)."""

    def __init__(self, payload: str, schema: T.StructType, nulls_missing: bool = True):
        self.nulls_missing = nulls_missing
        self.tree = self._open(F.col(payload), schema)

    def _open(self, c: Column, schema: T.StructType) -> dict:
        return {f.name: self._open(c[f.name], f.dataType) if isinstance(f.dataType, T.StructType) else c[f.name] for f in schema.fields}

    def _holder(self, path: tuple[str, ...], make: bool = False) -> dict | None:
        at = self.tree
        for part in path[:-1]:
            if part not in at:
                if not make:
                    return None
                at[part] = {}
            at = at[part]
            if not isinstance(at, dict):
                return None
        return at

    def apply(self, ops: list[Op]) -> StructPayload:
        for o in ops:
            at = self._holder(o.path, make=o.kind in ("set", "default"))
            if at is None:
                continue
            last = o.path[-1]
            if o.kind == "set":
                at[last] = F.lit(o.value)
            elif o.kind == "default":
                if last not in at:
                    at[last] = F.lit(o.value)
                elif self.nulls_missing and not isinstance(at[last], dict):
                    at[last] = F.coalesce(at[last], F.lit(o.value))
            elif o.kind == "remove":
                at.pop(last, None)
            elif last in at:
                value = at.pop(last) if o.kind == "rename" else at[last]
                target = self._holder(o.to, make=True)
                if target is not None:
                    target[o.to[-1]] = value
        return self

    def column(self) -> Column:
        def close(node: dict | Column) -> Column:
            return F.struct(*[close(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

        return close(self.tree)
