"""Bloom filters of a vocabulary, and which single edits of a word they may hold.

A word is a row of bytes, one for each code point up to U+00FF. Words of each length have a
filter of their own, of blocks of 64 bits: a word sets ``BITS`` bits of one block. The hash of
a word is a sum over its letters, so that of an edited word follows from the word's without
spelling it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from logweir.llm.words import mix64, text_bytes

# Bits a word sets, and bits of filter for each word.
BITS, ROOM = 5, 20
# Letters probed at once.
PROBED = 100_000

_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = np.uint64(0xD1342543DE82EF95)


def letters(word: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins (one more entry at the end) and all letters, one byte each."""
    begin, data = text_bytes(word)
    wide = data == 0xC3
    wide_before = np.append(0, np.cumsum(wide))
    out = data.copy()
    out[1:][wide[:-1]] += 0x40
    return begin - wide_before[begin], out[~wide]


def spelled(rows: np.ndarray) -> pa.Array:
    """Rows of letters as words."""
    flat = rows.ravel()
    size = 1 + (flat >= 0x80)
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0xC3, np.uint8)
    out[ends - 1] = np.where(flat >= 0x80, flat - 0x40, flat)
    offsets = np.append(0, ends)[:: rows.shape[1]].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(out))


def by_length(word: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each length: which they are, and their letters as a table."""
    begin, data = letters(word)
    length = np.diff(begin)
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == size)
        for at in range(0, len(rows), max(1, PROBED // int(size))):
            own = rows[at : at + max(1, PROBED // int(size))]
            yield own, data[begin[own][:, None] + np.arange(size)]


def _powers(size: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _FACTOR))])


def hashes(table: np.ndarray) -> np.ndarray:
    """The sum of each row, before it is scattered."""
    return (_LETTER[table] * _powers(table.shape[1])[: table.shape[1]]).sum(1, dtype=np.uint64)


def turn_of(sums: np.ndarray, turns: int) -> np.ndarray:
    """Which of several filters a word belongs to."""
    return mix64(sums ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(turns)


@dataclass(frozen=True)
class LengthFilter:
    """The filter of the words of one length."""

    blocks: np.ndarray

    def holds(self, sums: np.ndarray) -> np.ndarray:
        """Which of these hashes it may hold."""
        found = mix64(sums)
        here = np.arange(len(sums))
        block = self.blocks[block_of(found, len(self.blocks))]
        for k in range(BITS):
            bit = (found >> np.uint64(6 * k)) & np.uint64(63)
            set_ = ((block >> bit) & np.uint64(1)).astype(bool)
            here, found, block = here[set_], found[set_], block[set_]
        return here


def block_of(found: np.ndarray, blocks: int) -> np.ndarray:
    return ((found >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def marks(sums: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and the bits it sets there."""
    found = mix64(sums)
    bits = np.zeros(len(found), np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << ((found >> np.uint64(6 * k)) & np.uint64(63))
    return block_of(found, blocks), bits


def blocks_for(words: int) -> int:
    return max(1, -(-words * ROOM // 64))


def probed_edits(
    table: np.ndarray,
    filters: dict[int, LengthFilter],
    alphabet: np.ndarray,
    turn: int,
    turns: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edits of words of one length that the filters may hold: whose they are, their letters.

    A word gives what is left without one of its letters (the first of several equal ones), and
    itself with a letter replaced by a later one of ``alphabet``; insertions and replacements by
    earlier letters are these, seen from the other word. Of several filters used in turn, each
    is asked for its own edits.
    """
    rows, size = table.shape
    power = _powers(size)
    terms = _LETTER[table] * power[:size]

    def asked(sums: np.ndarray, of: LengthFilter) -> np.ndarray:
        here = of.holds(sums)
        return here if turns == 1 else here[turn_of(sums[here], turns) == turn]

    if size > 1 and size - 1 in filters:
        before = np.cumsum(terms, 1, dtype=np.uint64) - terms
        moved = _LETTER[table[:, 1:]] * power[: size - 1]
        behind = np.zeros_like(terms)
        behind[:, :-1] = np.cumsum(moved[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
        own = np.ones(table.shape, bool)
        own[:, 1:] = table[:, 1:] != table[:, :-1]
        at = np.flatnonzero(own)
        at = at[asked((before + behind).ravel()[at], filters[size - 1])]
        word, place = at // size, at % size
        column = np.arange(size - 1)
        yield word, table[word[:, None], column + (column >= place[:, None])]
    if size in filters:
        total = terms.sum(1, dtype=np.uint64)
        # In order of their letter, those before a given one are the first so many.
        order = np.argsort(table.ravel(), kind="stable")
        rest = (total[:, None] - terms).ravel()[order]
        step = np.broadcast_to(power[:size], table.shape).ravel()[order]
        below = np.searchsorted(table.ravel()[order], alphabet)
        for letter, count in zip(alphabet, below):
            sums = rest[:count] + _LETTER[letter] * step[:count]
            at = order[asked(sums, filters[size])]
            if len(at):
                word = at // size
                changed = table[word]
                changed[np.arange(len(at)), at % size] = letter
                yield word, changed
