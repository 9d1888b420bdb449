"""MessagePack to and from Python values (None, bool, int, float, str, bytes, list, dict)."""

from __future__ import annotations

import struct


class Ext:
    """An extension value; it has no JSON form."""

    def __init__(self, code: int, data: bytes):
        self.code, self.data = code, data


# first byte -> (length field's format, kind) of the sized families
_SIZED = {
    0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xC7: (">B", "ext"), 0xC8: (">H", "ext"), 0xC9: (">I", "ext"),
    0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "dict"), 0xDF: (">I", "dict"),
}
_PLAIN = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, fmt: str):
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def value(self):
        b = self.take(1)[0]
        if b <= 0x7F:
            return b
        if b >= 0xE0:
            return b - 256
        if b <= 0x8F:
            return self.sized("dict", b & 0x0F)
        if b <= 0x9F:
            return self.sized("list", b & 0x0F)
        if b <= 0xBF:
            return self.sized("str", b & 0x1F)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in _PLAIN:
            return self.number(_PLAIN[b])
        if 0xD4 <= b <= 0xD8:
            return self.sized("ext", 1 << (b - 0xD4))
        if b in _SIZED:
            fmt, kind = _SIZED[b]
            return self.sized(kind, self.number(fmt))
        raise ValueError(f"unknown type {b:#x}")

    def sized(self, kind: str, n: int):
        if kind == "str":
            return self.take(n).decode("utf-8", "replace")
        if kind == "bin":
            return self.take(n)
        if kind == "ext":
            code = self.number(">b")
            return Ext(code, self.take(n))
        if kind == "list":
            return [self.value() for _ in range(n)]
        out: dict = {}
        for _ in range(n):
            k = self.value()
            v = self.value()
            out.setdefault(k if isinstance(k, (str, int, float, bool, bytes, type(None))) else repr(k), v)  # the first of equal keys counts
        return out


def unpack(data: bytes):
    r = _Reader(data)
    v = r.value()
    if r.at != len(data):
        raise ValueError("bytes after the value")
    return v


def pack(v) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        if 0 <= v < 128 or -32 <= v < 0:
            return struct.pack(">b" if v < 0 else ">B", v)
        for code, fmt, lo, hi in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD3, ">q", -(1 << 63), 0)):
            if lo <= v < hi:
                return bytes([code]) + struct.pack(fmt, v)
        raise ValueError("integer too large")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        b = v.encode()
        return (bytes([0xA0 | len(b)]) if len(b) < 32 else b"\xdb" + struct.pack(">I", len(b))) + b
    if isinstance(v, bytes):
        return b"\xc6" + struct.pack(">I", len(v)) + v
    if isinstance(v, (list, tuple)):
        head = bytes([0x90 | len(v)]) if len(v) < 16 else b"\xdd" + struct.pack(">I", len(v))
        return head + b"".join(map(pack, v))
    if isinstance(v, dict):
        head = bytes([0x80 | len(v)]) if len(v) < 16 else b"\xdf" + struct.pack(">I", len(v))
        return head + b"".join(pack(k) + pack(x) for k, x in v.items())
    raise TypeError(type(v).__name__)


def to_json_value(v):
    """JSON form: binary as lower-case hex, extensions and non-finite numbers as null, keys as text."""
    if isinstance(v, bytes):
        return v.hex()
    if isinstance(v, Ext) or isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    if isinstance(v, list):
        return [to_json_value(x) for x in v]
    if isinstance(v, dict):
        return {k if isinstance(k, str) else str(k): to_json_value(x) for k, x in v.items()}
    return v
