"""CRC-32C (Castagnoli). Many records are checked at once, a byte column a step; a long one is cut into pieces whose
registers are computed side by side and joined by the operator that appends zero bytes. Tables come from the polynomial."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
ONES = 0xFFFFFFFF
#: Bytes from which a record is cut into pieces.
LONG = 2048


def _table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, (n >> 1) ^ np.uint32(POLYNOMIAL), n >> 1)
    return n


_TABLE = _table()


def _columns(rows: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers after all bytes of each row."""
    for j in range(rows.shape[1]):
        register = _TABLE[(register ^ rows[:, j]) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    return register


def _apply(operator: tuple[int, ...], register: int) -> int:
    out = 0
    while register:
        low = register & -register
        out ^= operator[low.bit_length() - 1]
        register ^= low
    return out


@lru_cache(maxsize=256)
def _zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes make of each bit of a register."""
    if n == 1:
        return tuple(int(_TABLE[(1 << i) & 0xFF]) ^ ((1 << i) >> 8) for i in range(32))
    half = _zeros(n // 2)
    twice = tuple(_apply(half, c) for c in half)
    return tuple(_apply(_zeros(1), c) for c in twice) if n % 2 else twice


def crc32c(data: bytes, crc: int = 0) -> int:
    register = crc ^ ONES
    if len(data) >= LONG:
        size = max(1, int(len(data) ** 0.5))
        pieces = len(data) // size
        rows = np.frombuffer(data, np.uint8, pieces * size).reshape(pieces, size)
        over = _zeros(size)
        for r in _columns(rows, np.zeros(pieces, np.uint32)).tolist():
            register = _apply(over, register) ^ r
        data = data[pieces * size :]
    for b in data:
        register = int(_TABLE[(register ^ b) & 0xFF]) ^ (register >> 8)
    return register ^ ONES


def crc32c_many(blocks: list[bytes]) -> np.ndarray:
    """The CRC of each block."""
    out = np.zeros(len(blocks), np.uint32)
    size = np.array([len(b) for b in blocks], np.int64)
    for i in np.flatnonzero(size >= LONG):
        out[i] = crc32c(blocks[i])
    short = np.flatnonzero(size < LONG)
    if not len(short):
        return out
    order = short[np.argsort(-size[short], kind="stable")]
    length = size[order]
    data = np.frombuffer(b"".join(blocks[i] for i in order) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    register = np.full(len(order), ONES, np.uint32)
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
    for j, n in enumerate(alive):
        register[:n] = _TABLE[(register[:n] ^ data[begin[:n] + j]) & np.uint32(0xFF)] ^ (register[:n] >> np.uint32(8))
    out[order] = register ^ np.uint32(ONES)
    return out
