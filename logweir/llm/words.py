"""Arrays over whole batches of texts: bytes, words and their hashes.

A text is read as UTF-8 bytes. A word is a longest run of bytes other than blanks
(0x20, 0x09-0x0D); no such byte occurs inside a longer UTF-8 character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What Arrow frees goes back to the allocator that ``give_back`` trims.
pa.set_memory_pool(pa.system_memory_pool())

# Texts worked on at once, in bytes: the arrays beside them take some thirty times as much.
SLICE_BYTES = 2_000_000
# Texts worked on at once, and counted together before they are dealt out by hash: the numbers
# of a chunk's documents, with one more slice, fit 16 bits.
SLICE_ROWS = 10_000
CHUNK_ROWS = 50_000
# Parts of a chunk sent together, in rows and in bytes.
SENT_ROWS, SENT_BYTES = 512, 1_000_000

# Bytes of text whose shingles or anchors are counted by one task.
PART_BYTES = 4_000_000
FEWEST_PARTS, MOST_PARTS = 64, 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def is_blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are blanks."""
    return _BLANK[data]


def mix64(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers; a bijection."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _of_place(length: int) -> np.ndarray:
    steps = np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix64(steps) | np.uint64(1)


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text and ``SLICE_ROWS`` rows.

    A longer text comes alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            to = min(to, at + SLICE_ROWS)
            yield batch.slice(at, to - at)
            at = to
    give_back()


_KEPT: dict = {}


def kept(key: object, make: Callable):
    """What ``make`` gives, kept in this worker until another key is asked for.

    Workers live on from task to task and from operator to operator; a vocabulary or model of
    one is not held beside those of the next.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what this worker keeps."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, as workers are kept between tasks and operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (one more entry at the end) and all bytes; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    begin = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None or begin[-1] == begin[0]:
        return np.zeros(len(filled) + 1, np.int64), np.empty(0, np.uint8)
    return begin - begin[0], np.frombuffer(data, np.uint8)[begin[0] : begin[-1]]


def sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with some columns of bytes in batches of a bounded number and size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= SENT_ROWS or size >= SENT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.types)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def hash_parts(size: int) -> int:
    """Parts of a hash space for texts of so many bytes: they grow with the texts."""
    return min(max(-(-size // PART_BYTES), FEWEST_PARTS), MOST_PARTS)


class Words:
    """The words of some texts: ``start``, ``end`` and ``hash`` of each, ``first`` by text.

    ``inside`` tells which bytes belong to words where these are not all but the blanks.
    """

    def __init__(self, begin: np.ndarray, data: np.ndarray, inside: np.ndarray | None = None):
        inside = ~_BLANK[data] if inside is None else inside
        opens = np.zeros(len(data) + 1, bool)
        opens[:-1] = inside
        opens[1:-1] &= ~inside[:-1]
        edge = begin[:-1][begin[:-1] < begin[1:]]
        opens[edge] = inside[edge]
        self.start = np.flatnonzero(opens)
        # A word ends at the next blank, the next text or the end of the data.
        stop = np.ones(len(data) + 1, bool)
        stop[:-1] = ~inside
        stop[begin] = True
        stops = np.flatnonzero(stop)
        self.end = stops[np.searchsorted(stops, self.start, "right")]
        self.first = np.searchsorted(self.start, begin)
        self.data = data

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return segment_hashes(self.data, self.start, self.end)


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some segments, which lie in order and apart."""
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], length)
    values = _OF_BYTE[data[place + np.repeat(start, length)]]
    values *= _of_place(int(length.max()))[place]
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return mix64(total[first[1:]] - total[first[:-1]] + length.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbouring hashes; callers drop runs over two texts."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k, weight in enumerate(_of_place(width)):
        total += words[k : len(total) + k] * weight
    return mix64(total)
