"""Filters as native Columns, two-valued: every leaf is true or false, never null, before NOT, AND and OR see it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamroute.operators.filters.interp import EPSILON
from streamroute.operators.filters.syntax import parse


class VariantFields:
    """Paths into a VARIANT payload. A missing path and a null in the payload are told apart; numbers, strings and
    booleans are told apart by the value's own type, nothing is coerced."""

    def __init__(self, payload: Column | str):
        self.payload = F.col(payload) if isinstance(payload, str) else payload

    def _path(self, path: tuple[str, ...]) -> str:
        return "$." + ".".join(path)

    def _raw(self, path: tuple[str, ...]) -> Column:
        return F.try_variant_get(self.payload, self._path(path), "variant")

    def _kind(self, path: tuple[str, ...]) -> Column:
        return F.schema_of_variant(self._raw(path))

    def missing(self, path: tuple[str, ...]) -> Column:
        return self._raw(path).isNull()

    def null(self, path: tuple[str, ...]) -> Column:
        return F.coalesce(F.is_variant_null(self._raw(path)), F.lit(False))

    def number(self, path: tuple[str, ...]) -> Column:
        """As double where the value is a number, else null."""
        k = self._kind(path)
        is_number = k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
        return F.when(is_number, F.try_variant_get(self.payload, self._path(path), "double"))

    def whole(self, path: tuple[str, ...]) -> Column:
        return F.when(self._kind(path) == "BIGINT", F.try_variant_get(self.payload, self._path(path), "double"))

    def string(self, path: tuple[str, ...]) -> Column:
        return F.when(self._kind(path) == "STRING", F.try_variant_get(self.payload, self._path(path), "string"))

    def boolean(self, path: tuple[str, ...]) -> Column:
        return F.when(self._kind(path) == "BOOLEAN", F.try_variant_get(self.payload, self._path(path), "boolean"))

    def size(self, path: tuple[str, ...]) -> Column:
        k = self._kind(path)
        return (
            F.when(k == "STRING", F.octet_length(F.try_variant_get(self.payload, self._path(path), "string")))
            .when(k.startswith("ARRAY"), F.size(F.try_variant_get(self.payload, self._path(path), "array<variant>")))
            .when(k.startswith("OBJECT"), F.size(F.try_variant_get(self.payload, self._path(path), "map<string,variant>")))
        )


class StructFields:
    """Paths into a struct payload, or into a row's own columns (prefix None). SQL nulls count as missing, or with
    nulls_are='null' as nulls of the payload."""

    def __init__(self, schema: T.StructType, prefix: str | None = None, nulls_are: str = "missing"):
        self.schema, self.prefix, self.nulls_are = schema, prefix, nulls_are

    def _find(self, path: tuple[str, ...]) -> tuple[Column | None, T.DataType | None]:
        kind: T.DataType = self.schema
        for part in path:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None, None
            kind = kind[part].dataType
        names = ([self.prefix] if self.prefix else []) + list(path)
        return F.col(".".join(f"`{n}`" for n in names)), kind

    def missing(self, path: tuple[str, ...]) -> Column:
        c, _ = self._find(path)
        return F.lit(True) if c is None else (c.isNull() if self.nulls_are == "missing" else F.lit(False))

    def null(self, path: tuple[str, ...]) -> Column:
        c, _ = self._find(path)
        return F.lit(False) if c is None or self.nulls_are == "missing" else c.isNull()

    def _typed(self, path: tuple[str, ...], kinds: tuple, cast: str) -> Column:
        c, kind = self._find(path)
        return c.cast(cast) if c is not None and isinstance(kind, kinds) else F.lit(None).cast(cast)

    def number(self, path: tuple[str, ...]) -> Column:
        return self._typed(path, (T.NumericType,), "double")

    def whole(self, path: tuple[str, ...]) -> Column:
        return self._typed(path, (T.IntegralType,), "double")

    def string(self, path: tuple[str, ...]) -> Column:
        return self._typed(path, (T.StringType,), "string")

    def boolean(self, path: tuple[str, ...]) -> Column:
        return self._typed(path, (T.BooleanType,), "boolean")

    def size(self, path: tuple[str, ...]) -> Column:
        c, kind = self._find(path)
        if isinstance(kind, T.StringType):
            return F.octet_length(c)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.when(c.isNotNull(), F.size(c))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.lit(len(kind.names)))
        return F.lit(None).cast("int")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _ordered(x: Column, op: str, want: Column) -> Column:
    return {"==": x == want, "!=": x != want, ">": x > want, "<": x < want, ">=": x >= want, "<=": x <= want}[op]


def _numeric(x: Column, op: str, want: float) -> Column:
    if op in ("==", "!="):
        same = F.abs(x - F.lit(want)) < F.lit(EPSILON)
        return same if op == "==" else ~same
    return ~F.isnan(x) & _ordered(x, op, F.lit(want))


def _comparison(fields, path: tuple[str, ...], op: str, want: object) -> Column:
    if want is None:
        absent = fields.missing(path) | fields.null(path)
        return {"==": absent, "!=": ~absent}.get(op, F.lit(False))
    if isinstance(want, bool):
        there = _sure(_ordered(fields.boolean(path), op, F.lit(want))) if op in ("==", "!=") else F.lit(False)
    elif isinstance(want, str):
        there = _sure(_ordered(fields.string(path), op, F.lit(want)))
    elif isinstance(want, float):
        there = _sure(_numeric(fields.number(path), op, want))
    else:
        there = F.lit(False)
    return fields.missing(path) | there if op == "!=" else there


def _call(fields, name: str, path: tuple[str, ...], args: list) -> Column:
    first = args[0] if args else None
    if name == "len":
        return _sure(fields.size(path) == F.lit(int(max(first, 0)))) if isinstance(first, float) else F.lit(False)
    if name == "in":
        items = first if isinstance(first, list) else []
        texts, numbers = [i for i in items if isinstance(i, str)], [i for i in items if isinstance(i, float)]
        hits = [_sure(fields.string(path).isin(*texts))] if texts else []
        hits += [_sure(F.abs(fields.whole(path) - F.lit(n)) < F.lit(EPSILON)) for n in numbers]
        return reduce(lambda a, b: a | b, hits, F.lit(False))
    if not isinstance(first, str):
        return F.lit(False)
    s = fields.string(path)
    return _sure({"contains": s.contains, "starts_with": s.startswith, "ends_with": s.endswith}[name](F.lit(first)))


def condition(tree: tuple, fields) -> Column:
    """The boolean Column of a tree over the given fields."""
    kind = tree[0]
    if kind == "not":
        return ~condition(tree[1], fields)
    if kind in ("and", "or"):
        a, b = condition(tree[1], fields), condition(tree[2], fields)
        return a & b if kind == "and" else a | b
    if kind == "cmp":
        return _comparison(fields, *tree[1:])
    if kind == "len":
        return _sure(_ordered(fields.size(tree[1]), tree[2], F.lit(tree[3]))) if isinstance(tree[3], float) else F.lit(False)
    return _call(fields, *tree[1:])


def compile_filter(text: str, fields, root_alias: str | None = None, strict: bool = False) -> Column:
    """Text to Column; raises FilterError before any job is run."""
    return condition(parse(text, strict, root_alias), fields)
