"""Re-Pair on arrays: frequent neighbouring symbols become one, again and again.

The grammar of a shard has a rule per new symbol, the first of which is ``base``: the two
symbols it stands for, both older than itself, and how many ids it expands to. No rule crosses
the end of a document, so every document is a run of symbols of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from logweir.llm.pieces import runs

# A pair that occurs fewer times is left as it is: a rule would take as much as it saves.
FEWEST = 8
# A round that saves less than this share of the symbols is the last one.
WORTH = 0.1

_NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Grammar:
    """Rules (``left``, ``right``, expansion ``size``) and the symbols they are applied to."""

    base: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    symbols: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        if not len(self.size):
            return np.ones(len(symbols), np.int64)
        rule = np.maximum(symbols - self.base, 0)
        return np.where(symbols < self.base, 1, self.size[rule]).astype(np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols, by replacing all new symbols level by level."""
        out = symbols
        while True:
            new = out >= self.base
            if not new.any():
                return out
            place = np.cumsum(new) - new + np.arange(len(out))
            wide = np.empty(len(out) + int(new.sum()), out.dtype)
            rule = out[new] - self.base
            wide[place[~new]] = out[~new]
            wide[place[new]] = self.left[rule]
            wide[place[new] + 1] = self.right[rule]
            out = wide

    def all_ids(self) -> np.ndarray:
        """All ids: each rule is expanded once, the symbols copy from there."""
        rules = np.arange(self.base, self.base + len(self.size), dtype=np.int32)
        flat = np.concatenate([np.arange(self.base, dtype=np.int32), self.expand(rules)])
        size = np.concatenate([np.ones(self.base, np.int32), self.size.astype(np.int32)])
        count = size[self.symbols]
        begin = (np.cumsum(size) - size)[self.symbols] - (np.cumsum(count) - count)
        place = np.repeat(begin.astype(np.int32), count)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place]

    def part(self, begin: int, end: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the symbols from ``first`` to ``last``.

        Only symbols that the range meets are expanded; expansion sizes find them.
        """
        own = self.symbols[first:last]
        ends = np.cumsum(self.sizes(own))
        total = int(ends[-1]) if len(ends) else 0
        begin, end = max(0, begin), min(end, total)
        if begin >= end:
            return np.empty(0, np.int32)
        a = int(np.searchsorted(ends, begin, "right"))
        b = int(np.searchsorted(ends, end, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[begin - before : end - before]


def _ordered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each below ``1 << bits``, and where they stood."""
    room = len(keys).bit_length()
    if bits + room > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    packed = np.sort((keys << room) | np.arange(len(keys)))
    return packed >> room, packed & ((1 << room) - 1)


def _ranks(
    symbols: np.ndarray, last: np.ndarray, weight: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs worth a rule, most frequent first, and the rank of the pair at each place."""
    rank = np.full(len(symbols) - 1, _NONE, np.int32)
    here = np.flatnonzero(~last[:-1])
    bits = int(symbols.max()).bit_length()
    pairs, order = _ordered((symbols[here].astype(np.int64) << bits) | symbols[here + 1], 2 * bits)
    here = here[order]
    if not len(here):
        return np.empty((0, 2), np.int32), rank
    first = np.append(0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)
    size = np.diff(np.append(first, len(pairs)))
    count = size if weight is None else np.add.reduceat(weight[here], first)
    chosen = np.flatnonzero(count >= FEWEST)
    chosen = chosen[np.argsort(-count[chosen], kind="stable")]
    rank[here[runs(first[chosen], size[chosen])]] = np.repeat(
        np.arange(len(chosen), dtype=np.int32), size[chosen]
    )
    found = pairs[first[chosen]]
    return np.stack([found >> bits, found & ((1 << bits) - 1)], 1).astype(np.int32), rank


def _taken(rank: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: none overlap, the more frequent of two neighbours goes first."""
    wide = np.concatenate([[_NONE], rank, [_NONE]])
    here, before, after = wide[1:-1], wide[:-2], wide[2:]
    taken = (here < before) & (here <= after)
    # One symbol many times over: every second place of the run.
    same = np.flatnonzero((here == after) & (here != _NONE))
    if len(same):
        opens = np.append(True, np.diff(same) > 1)
        begin = same[opens]
        length = np.diff(np.append(np.flatnonzero(opens), len(same))) + 1
        half = (length - 1) // 2
        more = np.repeat(begin, half) + 2 * (runs(np.zeros(len(half), np.int64), half) + 1)
        taken[more[here[more] <= after[more]]] = True
    return np.flatnonzero(taken)


class _Rules:
    """Rules as they are made."""

    def __init__(self, base: int):
        self.base = base
        self.left = self.right = self.size = np.empty(0, np.int32)

    def add(self, pairs: np.ndarray) -> int:
        """Rules for some pairs; the symbol of the first."""
        older = self.grammar(np.empty(0, np.int32))
        size = (older.sizes(pairs[:, 0]) + older.sizes(pairs[:, 1])).astype(np.int32)
        self.left = np.concatenate([self.left, pairs[:, 0]])
        self.right = np.concatenate([self.right, pairs[:, 1]])
        self.size = np.concatenate([self.size, size])
        return self.base + len(older.size)

    def grammar(self, symbols: np.ndarray) -> Grammar:
        return Grammar(self.base, self.left, self.right, self.size, symbols)

    def apply(
        self, symbols: np.ndarray, last: np.ndarray, weight: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Replace frequent pairs round by round, none across a ``last`` symbol.

        ``weight`` tells how often each place counts.
        """
        while len(symbols) > 1:
            pairs, rank = _ranks(symbols, last, weight)
            at = _taken(rank)
            saved = np.bincount(rank[at], None if weight is None else weight[at], len(pairs))
            used = saved > 1
            at = at[used[rank[at]]]
            if not len(at):
                break
            first = self.add(pairs[used])
            name = (np.cumsum(used) - 1 + first).astype(np.int32)
            symbols[at] = name[rank[at]]
            last[at] = last[at + 1]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            total = len(symbols) if weight is None else weight.sum()
            symbols, last = symbols[stays], last[stays]
            weight = None if weight is None else weight[stays]
            if saved[used].sum() < WORTH * total:
                break
        return symbols, last


def _lengths(last: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Symbols of each run that ``last`` closes; runs not ``filled`` have none."""
    counts = np.zeros(len(filled), np.int64)
    counts[filled] = np.diff(np.flatnonzero(last), prepend=-1)
    return counts


def _last(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    last = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    last[ends[counts > 0] - 1] = True
    return last


def compress(
    place: np.ndarray, first: np.ndarray, counts: np.ndarray, ids: np.ndarray, base: int
) -> tuple[Grammar, np.ndarray]:
    """The grammar of some texts given as pieces, and the number of symbols of each text.

    ``counts`` and ``ids`` are the ids of each different piece, all below ``base``; ``place``
    tells the pieces of the texts one after the other and ``first`` where each text begins.
    Pairs inside of pieces are replaced once per different piece, counted as often as it
    comes; then pairs of what is left, over whole texts.
    """
    rules = _Rules(base)
    often = np.bincount(place, minlength=len(counts)).astype(np.float64)
    inside, last = rules.apply(ids.astype(np.int32), _last(counts), np.repeat(often, counts))
    sizes = _lengths(last, counts > 0)
    begin = np.cumsum(sizes) - sizes
    symbols = inside[runs(begin[place], sizes[place])]
    ends = np.append(0, np.cumsum(sizes[place]))
    symbols, last = rules.apply(symbols, _last(np.diff(ends[first])))
    return rules.grammar(symbols), _lengths(last, np.diff(ends[first]) > 0)
