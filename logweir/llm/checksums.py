"""CRC-32 of joined pieces from the CRC-32 of each, for whole arrays at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_POLYNOMIAL = 0xEDB88320


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by what it makes of each bit."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@cache
def _append_zeros() -> list[np.ndarray]:
    """Tables of what 1, 2, 4, ... zero bytes behind it make of a checksum, byte by byte."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = bits.copy()
    for _ in range(8):
        columns = (columns >> np.uint32(1)) ^ np.where(
            columns & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0)
        )
    tables = []
    every = np.arange(256, dtype=np.uint32)
    for _ in range(40):
        tables.append(np.stack([_apply(columns, every << np.uint32(8 * k)) for k in range(4)]))
        columns = _apply(columns, columns)
    return tables


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of the checksum of A + B that stems from A: from A's, and the bytes of B."""
    out = crc.astype(np.uint32)
    length = np.asarray(length, np.int64)
    for power, table in enumerate(_append_zeros()):
        step = 1 << power
        if not len(length) or step > length.max():
            break
        rows = np.flatnonzero(length & step)
        x = out[rows]
        out[rows] = (
            table[0][x & 0xFF]
            ^ table[1][(x >> np.uint32(8)) & 0xFF]
            ^ table[2][(x >> np.uint32(16)) & 0xFF]
            ^ table[3][x >> np.uint32(24)]
        )
    return out


def joined(first: int, second: int, second_bytes: int) -> int:
    """The checksum of A + B from those of A and B."""
    return int(shifted(np.array([first], np.uint32), np.array([second_bytes]))[0]) ^ second
