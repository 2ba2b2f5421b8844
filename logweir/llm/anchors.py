"""Anchors of the windows of a text: what equal windows agree on wherever they stand."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from logweir.llm.words import _OF_BYTE, mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Hash bits that pick an anchor; the others hold the place, so that of equal ones the first wins.
_PLACE_BITS = np.uint64(22)
_STEP = 1 << 21


class Runs(NamedTuple):
    """Windows first..last (their beginnings) that share an anchor at ``at`` with ``hash``."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    hash: np.ndarray


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A rolling hash of each run of ``width`` bytes, by doubling."""
    single = _OF_BYTE[data]
    total, length = single, 1
    for bit in bin(width)[3:]:
        power = np.uint64(pow(int(_BASE), length, 1 << 64))
        total = total[: len(total) - length] * power + total[length:]
        length *= 2
        if bit == "1":
            count = len(total) - 1
            total = total[:count] * _BASE + single[length : length + count]
            length += 1
    return mix64(total)


def anchors(begin: np.ndarray, data: np.ndarray, window: int, width: int) -> Runs:
    """Runs of windows of ``window`` bytes, inside the texts, with one anchor each.

    The anchor of a window is its run of ``width`` bytes with the least hash, the first of
    equal ones. So it depends on the window's bytes alone.
    """
    parts = [
        _anchors(begin, data, window, width, start)
        for start in range(0, max(0, len(data) - window + 1), _STEP)
    ]
    if not parts:
        nothing = np.empty(0, np.int64)
        return Runs(nothing, nothing, nothing, np.empty(0, np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*parts)))


def _anchors(begin: np.ndarray, data: np.ndarray, window: int, width: int, start: int) -> Runs:
    some = data[start : start + _STEP + window - 1]
    hashes = _gram_hashes(some, width)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    reach, spread = window - width + 1, 1
    while 2 * spread <= reach:
        least = np.minimum(least[:-spread], least[spread:])
        spread *= 2
    if spread < reach:
        more = reach - spread
        least = np.minimum(least[:-more], least[more:])
    at = (least & mask).astype(np.int64)
    # Windows over the edge of two texts are none.
    end = np.searchsorted(begin, np.arange(start, start + len(at)), "right")
    inside = begin[np.minimum(end, len(begin) - 1)] >= np.arange(start, start + len(at)) + window
    places = np.flatnonzero(inside)
    if not len(places):
        nothing = np.empty(0, np.int64)
        return Runs(nothing, nothing, nothing, np.empty(0, np.uint64))
    own = at[places]
    new = np.append(True, (own[1:] != own[:-1]) | (places[1:] != places[:-1] + 1))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(places)) - 1
    return Runs(
        places[heads] + start, places[tails] + start, own[heads] + start, hashes[own[heads]]
    )
