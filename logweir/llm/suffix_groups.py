"""Suffix arrays by groups of suffixes with equal longest Lyndon prefixes.

Groups begin as the suffixes of one first symbol and are taken in descending order. When a
group is taken, its suffixes cannot be extended any more: each run of neighbouring ones is
appended to the nearest suffix on the left of a smaller group (the previous-smaller pointer),
which moves to a new group just above its old one, the higher the longer the run. In the end
the groups are sorted by their Lyndon prefixes. The order inside a group is that of what
follows the prefixes; one ascending pass along the pointers emits it, and nothing is renamed or
sorted again. Both passes are linear.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lyndon_groups(text: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Groups in descending order, and of each suffix the previous one of a smaller group."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(text[order]) != 0))[:n]
    symbols = np.zeros(n, np.int64)
    symbols[edges] = 1
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(symbols) - 1
    group = of.tolist()
    members = [g.tolist() for g in np.split(order, edges[1:])] if n else []
    up = list(range(1, len(members))) + [-1] if members else []
    down = list(range(-1, len(members) - 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    group.append(-1)  # behind the last suffix
    left.append(n - 1)
    smaller = [-1] * n
    done = []
    now = len(members) - 1
    while now >= 0:
        mine = [s for s in members[now] if group[s] == now]
        members[now] = None
        if mine:
            done.append(mine)
            grown: dict[int, list[int]] = {}
            for s in mine:
                p = left[s]
                if p >= 0 and group[p] == now:
                    continue  # inside a run
                length, t = 0, s
                while group[t] == now:
                    smaller[t] = p
                    length += 1
                    t = right[t]
                left[t] = p
                if p >= 0:
                    right[p] = t
                    if length in grown:
                        grown[length].append(p)
                    else:
                        grown[length] = [p]
            top: dict[int, int] = {}
            for length in sorted(grown):
                fresh: dict[int, int] = {}
                for p in grown[length]:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        below = top.get(old, old)
                        above = up[below]
                        up.append(above)
                        down.append(below)
                        up[below] = new
                        if above >= 0:
                            down[above] = new
                    members[new].append(p)
                # Only now, so that a suffix of this length is not taken for a grown one.
                for old, new in fresh.items():
                    top[old] = new
                    for p in members[new]:
                        group[p] = new
        now = down[now]
    return done, smaller


def suffix_array(text: Sequence[int] | np.ndarray) -> list[int]:
    """Beginnings of all suffixes of a sequence of integers, in order."""
    text = np.asarray(text, np.int64)
    n = len(text)
    groups, smaller = lyndon_groups(text)
    free = [0] * len(groups)
    of = [0] * n
    at = 0
    for g in range(len(groups) - 1, -1, -1):
        free[g] = at
        at += len(groups[g])
        for s in groups[g]:
            of[s] = g
    result = [-1] * n
    placed = bytearray(n)

    def emit(s: int) -> None:
        while s >= 0 and not placed[s]:
            g = of[s]
            result[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = smaller[s]

    emit(n - 1)
    for k in range(n):
        s = result[k] - 1
        if s >= 0 and not placed[s]:
            emit(s)
    return result
