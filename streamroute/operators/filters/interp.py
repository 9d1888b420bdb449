"""Filters over plain Python values: the tests' yardstick for the compiled form."""

from __future__ import annotations

import math
import operator

EPSILON = 2.220446049250313e-16
_OPS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
MISSING = object()


def lookup(data: object, path: tuple[str, ...]) -> object:
    for part in path:
        if not isinstance(data, dict) or part not in data:
            return MISSING
        data = data[part]
    return data


def _is_number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _compare(v: object, op: str, want: object) -> bool:
    absent = v is MISSING or v is None
    if want is None:
        return op == ("==" if absent else "!=")
    if absent:
        return v is MISSING and op == "!="
    if isinstance(want, bool):
        return isinstance(v, bool) and op in ("==", "!=") and _OPS[op](v, want)
    if isinstance(want, str):
        return isinstance(v, str) and _OPS[op](v.encode(), want.encode())
    if isinstance(want, float) and _is_number(v):
        x = float(v)
        if op in ("==", "!="):
            same = abs(x - want) < EPSILON
            return same if op == "==" else not same
        return not math.isnan(x) and _OPS[op](x, want)
    return False


def size_of(v: object) -> int | None:
    if isinstance(v, str):
        return len(v.encode())
    return len(v) if isinstance(v, (list, dict)) else None


def evaluate(tree: tuple, data: object) -> bool:
    kind = tree[0]
    if kind == "and":
        return evaluate(tree[1], data) and evaluate(tree[2], data)
    if kind == "or":
        return evaluate(tree[1], data) or evaluate(tree[2], data)
    if kind == "not":
        return not evaluate(tree[1], data)
    if kind == "cmp":
        return _compare(lookup(data, tree[1]), tree[2], tree[3])
    if kind == "len":
        n = size_of(lookup(data, tree[1]))
        return n is not None and _is_number(tree[3]) and _OPS[tree[2]](n, tree[3])
    _, name, path, args = tree
    v = lookup(data, path)
    first = args[0] if args else None
    if name == "len":
        n = size_of(v)
        return n is not None and isinstance(first, float) and n == int(max(first, 0))
    if name == "in":
        items = first if isinstance(first, list) else []
        if isinstance(v, str):
            return v in [i for i in items if isinstance(i, str)]
        whole = isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63
        return whole and any(abs(float(v) - i) < EPSILON for i in items if isinstance(i, float))
    test = {"contains": str.__contains__, "starts_with": str.startswith, "ends_with": str.endswith}[name]
    return isinstance(v, str) and isinstance(first, str) and test(v, first)
