"""Run-length grammars by recompression, and longest common extensions on them.

Level by level, runs of one symbol become one symbol (block compression), then neighbours of
which the first is a left and the second a right symbol become one (pair compression). Which
symbols are left is drawn anew on each level, by symbol alone, so equal stretches are compressed
alike wherever they stand, up to their edges. An extension climbs the levels while both places
begin a symbol and compares at most one symbol on each; where symbols differ it goes down again.

Several texts are compressed at once: each is closed by a separator of its own, which equals
nothing and takes part in no block and no pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from logweir.llm.words import mix64


@dataclass(frozen=True)
class Level:
    """The symbols of a level, and which stretch of them each symbol of the next one stands for.

    ``up`` is the place in the next level, ``first`` and ``last`` the stretch of each place there.
    """

    symbols: np.ndarray
    up: np.ndarray
    first: np.ndarray
    last: np.ndarray
    blocks: bool


def _named(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values get equal names from 0 on."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    names = np.empty(len(values), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


class RunLengthGrammar:
    """Levels over ``symbols`` (small non-negative numbers), texts that end at ``ends``.

    Symbol k of text t stands at place k + t + 1, behind the separators before it.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        # Separators are negative: a symbol of no level.
        at = np.append(0, ends)
        here = np.insert(symbols.astype(np.int64), at, -1 - np.arange(len(at)))
        self.levels: list[Level] = []
        names = int(symbols.max()) + 1 if len(symbols) else 0
        turn = 0
        # Done when no two neighbours are symbols: each text is one symbol, or none.
        while len(here) > 1:
            inside = (here[:-1] >= 0) & (here[1:] >= 0)
            if not inside.any():
                break
            same = inside & (here[:-1] == here[1:])
            if same.any():
                here, names = self._add(here, same, names, True)
                continue
            left = np.zeros(len(here), bool)
            real = here >= 0
            left[real] = mix64(here[real].astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)
            turn += 1
            pair = inside & left[:-1] & ~left[1:]
            if pair.any():
                here, names = self._add(here, pair, names, False)
        self.top = here

    def _add(self, here: np.ndarray, joins: np.ndarray, names: int, blocks: bool) -> tuple:
        """Put places that ``joins`` ties to the next one together as new symbols."""
        opens = np.append(True, ~joins)
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(here)) - 1
        above = here[first]
        many = np.flatnonzero(last > first)
        second = (last - first)[many] if blocks else here[last[many]]
        wide = np.int64(max(names, len(here)) + 1)
        found, count = _named(above[many] * wide + second)
        above[many] = names + found
        kind = np.int32 if max(names + count, len(here)) < 2**31 - 1 else np.int64
        self.levels.append(
            Level(
                here.astype(kind),
                (np.cumsum(opens) - 1).astype(kind),
                first.astype(kind),
                last.astype(kind),
                blocks,
            )
        )
        return above, names + count

    def extension(self, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
        """For how many places the texts agree from ``a`` and ``b`` on; to the left for step -1.

        Places count separators; ``a`` and ``b`` differ. A separator agrees with nothing.
        """
        out = np.zeros(len(a), np.int64)
        low, high = a.astype(np.int64), b.astype(np.int64)
        # Queries still climbing, and for each level those that turn back there.
        query = np.arange(len(a))
        turned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in self.levels:
            edge, far = (level.first, level.last) if step > 0 else (level.last, level.first)
            up_a, up_b = level.up[low], level.up[high]
            aligned = (edge[up_a] == low) & (edge[up_b] == high)
            equal = level.symbols[low] == level.symbols[high]
            left_a, left_b = abs(far[up_a] - low) + 1, abs(far[up_b] - high) + 1
            # Not both at the edge: what is left of one symbol above is compared here.
            moves = ~aligned & equal
            taken = np.minimum(left_a, left_b) if level.blocks else np.int64(1)
            low = np.where(moves, low + step * taken, low)
            high = np.where(moves, high + step * taken, high)
            climbs = aligned | equal
            if level.blocks:
                climbs &= aligned | (left_a == left_b)
            turned.append((query[~climbs], low[~climbs], high[~climbs]))
            query, low, high = query[climbs], low[climbs], high[climbs]
            low, high = (level.up[place].astype(np.int64) for place in (low, high))
        # Whole texts may be equal; what closes them is not.
        equal = self.top[low] == self.top[high]
        low, high = low + step * equal, high + step * equal
        for level, (others, other_a, other_b) in zip(self.levels[::-1], turned[::-1]):
            # Symbols above differ: their stretches here agree for one symbol at most.
            edge, far = (level.first, level.last) if step > 0 else (level.last, level.first)
            own_a, own_b = edge[low].astype(np.int64), edge[high].astype(np.int64)
            equal = level.symbols[own_a] == level.symbols[own_b]
            if level.blocks:
                taken = np.minimum(abs(far[low] - own_a), abs(far[high] - own_b)) + 1
            else:
                taken = np.int64(1)
            low = np.concatenate([np.where(equal, own_a + step * taken, own_a), other_a])
            high = np.concatenate([np.where(equal, own_b + step * taken, own_b), other_b])
            query = np.concatenate([query, others])
        out[query] = abs(low - a[query])
        return out
