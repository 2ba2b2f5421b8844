"""Which lengths fill a window together, and how often: a plan over a histogram of lengths.

Lengths are counted in classes of UNIT tokens, rounded up, so the plan is as large for any
number of documents. Shallow combinations that fill the window exactly are enumerated,
non-negative least squares finds how often each is used, the counts are rounded down to what
is there, and the rest is packed greedily, the largest first.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

UNIT = 8
DEPTH = 3
# Units of a window that greedy packing may leave empty before it cuts its largest piece.
SLACK = 4
# Pieces of more units than this may be cut, at the largest power of two below them.
LEAST_CUT = 32

WHOLE, HEAD, TAIL = 0, 1, 2


class Pattern(NamedTuple):
    """``repeats`` sequences of the same items: (item type, times in a sequence) in order."""

    repeats: int
    items: tuple[tuple[int, int], ...]


class Plan(NamedTuple):
    patterns: list[Pattern]
    # Of each class, as many pieces stay whole; the others are cut once.
    whole: dict[int, int]


def item_type(units: int, form: int) -> int:
    return 3 * units + form


def head_units(units: int) -> int:
    """Units of the head of a cut piece: the largest power of two below it."""
    return 1 << ((units - 1).bit_length() - 1)


def combinations(room: int, depth: int = DEPTH, most: int | None = None) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``depth`` numbers that sum to ``room``."""
    if room == 0:
        return [()]
    if depth == 0:
        return []
    top = min(room, most or room)
    return [
        (first, *rest)
        for first in range(top, 0, -1)
        if first * depth >= room
        for rest in combinations(room - first, depth - 1, first)
    ]


def _least_squares(matrix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    gram = matrix.T @ matrix
    gram[np.diag_indices_from(gram)] *= 1 + 1e-12
    try:
        return np.linalg.solve(gram, matrix.T @ wanted)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, wanted, rcond=None)[0]


def nnls(matrix: np.ndarray, wanted: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with the least |matrix x - wanted|: the active set method of Lawson and Hanson."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(matrix.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(wanted).max())
    for _ in range(rounds):
        gradient = matrix.T @ (wanted - matrix @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            solved = _least_squares(matrix[:, columns], wanted)
            if (solved > 0).all():
                x[:] = 0
                x[columns] = solved
                break
            # Move as far as all stay non-negative, and let those at zero go.
            low = solved <= 0
            step = (x[columns][low] / (x[columns][low] - solved[low])).min()
            x[columns] += step * (solved - x[columns])
            gone = columns[low & (x[columns] <= tolerance)]
            x[gone] = 0
            active[gone] = False
            if not len(gone):
                break
    return x


def make_plan(histogram: dict[int, int], window: int, depth: int = DEPTH) -> Plan:
    """A plan for pieces counted by units (1 to ``window``, itself in units)."""
    left = dict.fromkeys(range(1, window + 1), 0) | histogram
    patterns = []
    if left[window]:
        patterns.append(Pattern(left[window], ((item_type(window, WHOLE), 1),)))
        left[window] = 0
    used = dict.fromkeys(left, 0)
    tuples = [c for c in combinations(window, depth) if len(c) > 1 and all(left[u] for u in c)]
    if tuples:
        matrix = np.zeros((window + 1, len(tuples)))
        for k, units in enumerate(tuples):
            for u in units:
                matrix[u, k] += 1
        counts = np.array([0, *(left[u] for u in range(1, window + 1))], float)
        scale = counts.max()
        times = nnls(matrix, counts / scale) * scale
        for k in np.argsort(-times, kind="stable"):
            units = tuples[k]
            need = {u: units.count(u) for u in units}
            repeats = min(round(times[k]), *(left[u] // n for u, n in need.items()))
            if times[k] <= 0 or repeats <= 0:
                continue
            patterns.append(
                Pattern(repeats, tuple((item_type(u, WHOLE), n) for u, n in need.items()))
            )
            for u, n in need.items():
                left[u] -= repeats * n
                used[u] += repeats * n
    whole = dict(used)
    patterns += _greedy(left, window, whole)
    return Plan(patterns, whole)


def _greedy(left: dict[int, int], window: int, whole: dict[int, int]) -> list[Pattern]:
    """Pack what is left, largest first and then the largest that fits; cut against waste."""
    pool: dict[int, dict[int, int]] = {
        u: {item_type(u, WHOLE): n} for u, n in left.items() if n
    }
    patterns = []
    while pool:
        room, chosen = window, []
        taken: dict[int, int] = {}
        for units in sorted(pool, reverse=True):
            for item, count in pool[units].items():
                times = min(room // units, count)
                if times:
                    chosen.append((units, item, times))
                    taken[item] = times
                    room -= units * times
        first = chosen[0][1]
        units = first // 3
        if room > SLACK and first % 3 == WHOLE and units > LEAST_CUT and units & (units - 1):
            # No smaller piece fills this window, so all of this class are cut.
            count = pool[units].pop(first)
            head = head_units(units)
            for size, form in ((head, HEAD), (units - head, TAIL)):
                pool.setdefault(size, {})[item_type(units, form)] = count
            if not pool[units]:
                del pool[units]
            continue
        repeats = min(pool[units_][item] // times for units_, item, times in chosen)
        patterns.append(Pattern(repeats, tuple((item, times) for _, item, times in chosen)))
        for units_, item, times in chosen:
            pool[units_][item] -= repeats * times
            if item % 3 == WHOLE:
                whole[units_] += repeats * times
            if not pool[units_][item]:
                del pool[units_][item]
            if not pool[units_]:
                del pool[units_]
    return patterns
