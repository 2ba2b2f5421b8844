"""Nearest neighbours by collision counting.

An index has tables of cells. A table has two sets of random lines, and a vector lies in the cell
of the two lines, one of each set and either way along them, on which its projections are
largest. A query opens a window in every table: the cells on whose lines its own projections sum
to enough. The windows widen step by step over the same tables (virtual rehashing). Vectors that
lie in the windows of several tables are verified at each step, until those found are nearer
than what vectors still outside are likely to be.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLES = 48
# Share of all cells that a window holds on average, step by step.
SHARES = tuple(2 ** (s / 2 - 13) for s in range(21))
# Collisions a vector needs.
COLLISIONS = 4
# Chance with which a vector as near as the k-th found has to have them before windows stop.
SURE = 0.95
# Vectors of one index have norms above this share of its largest; so few are verified whole.
NORMS = 0.8
FEW = 64
# Lines of a set: the root of the vectors by this, within these bounds.
ROOT_PER_LINE = 10
LEAST_LINES, MOST_LINES = 4, 32
# Vectors hashed at once, and queries that open their first windows at the same step.
HASH_ROWS = 4_096
CHUNK = 16
# Vectors per block of the index, and components of them.
BLOCK_ROWS = 262_144
BLOCK_NUMBERS = 1 << 24
# Queries that visit a block together: so many, or a quarter of all up to the most.
QUERY_ROWS = 1_024
QUERY_GROUPS = 4
QUERY_MOST = 32_768


def _lines(dims: int, lines: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims + 1, lines)).astype(np.float32)


def _norms(vectors: np.ndarray) -> np.ndarray:
    peak = np.abs(vectors).max(axis=1).astype(np.float64)
    return peak * np.sqrt(((vectors / peak[:, None]) ** 2).sum(axis=1))


def _least(shares: Sequence[float]) -> list[float]:
    """The sum of two normal numbers that is exceeded with the chance of each share."""
    return [math.sqrt(2) * NormalDist().inv_cdf(1 - share) for share in shares]


@lru_cache(maxsize=64)
def _reach(
    shares: tuple[float, ...], lines: int, tables: int, collisions: int, sure: float
) -> list[float]:
    """The cosine down to which a vector has the collisions with the chance ``sure``, by step.

    On a line, the query's projection is normal around the cosine times the vector's. The
    vector's on its own two lines are the largest of ``lines`` either way.
    """
    low, high = 0.0, 1.0
    for _ in range(40):
        p = (low + high) / 2
        tail = range(collisions, tables + 1)
        chance = sum(math.comb(tables, c) * p**c * (1 - p) ** (tables - c) for c in tail)
        low, high = (p, high) if chance < sure else (low, p)
    needed = low
    ranks = [(i + 0.5) / 16 for i in range(16)]
    largest = np.array([NormalDist().inv_cdf((1 + r ** (1 / lines)) / 2) for r in ranks])
    sums = (largest[:, None] + largest).ravel()
    erf = np.vectorize(math.erf)

    def met(cosine: float, least: float) -> float:
        z = (cosine * sums - least) / math.sqrt(2 * (1 - cosine**2))
        return float((1 + erf(z / math.sqrt(2))).mean() / 2)

    reach = []
    for least in _least(shares):
        low, high = 0.0, 1 - 1e-9
        if met(high, least) < needed:
            reach.append(math.inf)
            continue
        for _ in range(25):
            cosine = (low + high) / 2
            low, high = (cosine, high) if met(cosine, least) < needed else (low, cosine)
        reach.append(high)
    return reach


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    end = np.cumsum(length)
    return np.repeat(begin - end + length, length) + np.arange(end[-1] if len(end) else 0)


class Shell:
    """Some rows of ``vectors``, of like norm, by their cells in every table."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, norms: np.ndarray, tables: int):
        self.rows, self.most, self.tables = rows, float(norms.max()), tables
        self.units = (vectors[rows] / self.most).astype(np.float32, copy=False)
        if len(rows) <= FEW:
            return
        lines = round(math.sqrt(len(rows)) / ROOT_PER_LINE)
        self.lines = max(LEAST_LINES, min(lines, MOST_LINES))
        self.directions = _lines(vectors.shape[1], 2 * tables * self.lines)
        # One more coordinate makes all norms equal, so that the largest inner product is the
        # largest cosine.
        rest = np.sqrt(np.maximum(1 - (self.units * self.units).sum(axis=1), 0.0))
        self.order = np.empty((tables, len(rows)), np.int32)
        cells = (2 * self.lines) ** 2
        sizes = np.empty((tables, cells), np.int64)
        for table in range(tables):
            cell = self._cells(table, rest)
            sizes[table] = np.bincount(cell, minlength=cells)
            self.order[table] = np.argsort(cell, kind="stable")
        self.order = self.order.ravel()
        self.begin = np.append(0, np.cumsum(sizes))

    def _cells(self, table: int, rest: np.ndarray) -> np.ndarray:
        width = 2 * self.lines
        lines = self.directions[:, table * width : (table + 1) * width]
        cell = np.empty(len(rest), np.uint16)
        for at in range(0, len(rest), HASH_ROWS):
            some = slice(at, at + HASH_ROWS)
            placed = self.units[some] @ lines[:-1] + rest[some, None] * lines[-1]
            placed = placed.reshape(-1, self.lines)
            best = np.abs(placed).argmax(axis=1)
            below = placed[np.arange(len(placed)), best] < 0
            best = (best + self.lines * below).reshape(-1, 2)
            cell[some] = best[:, 0] * width + best[:, 1]
        return cell

    def places(self, units: np.ndarray) -> np.ndarray:
        """Projections on the lines, both ways, by query, set of lines and table."""
        placed = (units @ self.directions[:-1]).reshape(len(units), self.tables, 2, self.lines)
        return np.concatenate([placed, -placed], axis=3).transpose(0, 2, 1, 3)

    def met(
        self, first: np.ndarray, second: np.ndarray, least: float, collisions: int
    ) -> np.ndarray:
        """Vectors in so many windows: of the cells on whose lines the places sum to enough."""
        table, i = np.nonzero(first >= (least - second.max(axis=1))[:, None])
        mate_table, j = np.nonzero(second >= (least - first.max(axis=1))[:, None])
        mates = np.bincount(mate_table, minlength=self.tables)
        of = np.repeat(np.arange(len(table)), mates[table])
        mate = _spans((np.cumsum(mates) - mates)[table], mates[table])
        inside = first[table, i][of] + second[mate_table, j][mate] >= least
        of, mate = of[inside], mate[inside]
        width = 2 * self.lines
        cell = (table[of] * width + i[of]) * width + j[mate]
        begin = self.begin[cell]
        held = self.order[_spans(begin, self.begin[cell + 1] - begin)]
        held.sort()
        held = held[collisions - 1 :][held[collisions - 1 :] == held[: 1 - collisions or None]]
        return held[np.diff(held, prepend=-1) != 0]


class Block:
    """Some vectors: equal ones are one, and those of like norm share an index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tables: int):
        # Zeros of either sign are equal.
        whole = np.ascontiguousarray(vectors + vectors.dtype.type(0))
        packed = whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel()
        _, first, of = np.unique(packed, return_index=True, return_inverse=True)
        self.vectors, self.of, self.ids = whole[first], of.ravel(), ids
        del whole, packed
        self.by_id, self.by_vector = np.argsort(ids), np.lexsort((ids, self.of))
        self.copies = np.bincount(self.of)
        self.first = np.append(0, np.cumsum(self.copies))
        norms = _norms(self.vectors)
        falling = np.argsort(-norms, kind="stable")
        self.shells, at = [], 0
        while at < len(falling):
            bound = -norms[falling[at]] * NORMS
            to = max(at + 1, int(np.searchsorted(-norms[falling], bound, "left")))
            rows = falling[at:to]
            self.shells.append(Shell(rows, self.vectors, norms[rows], tables))
            at = to

    def nearest(
        self,
        query_ids: np.ndarray,
        queries: np.ndarray,
        k: int,
        shares: Sequence[float],
        collisions: int,
        sure: float,
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the ``k`` best found, by query; rows of its own id are left out."""
        norms = _norms(queries)
        units = (queries / norms[:, None]).astype(np.float32)
        wide = queries.astype(np.float64)
        least = _least(shares)
        # Sums in single precision may be off by so much.
        margin = 4 * np.finfo(np.float32).eps * queries.shape[1]
        # The k best different vectors of each query so far.
        rows = [np.empty(0, np.int64)] * len(queries)
        scores = [np.empty(0)] * len(queries)
        own = [self._of_id(i) for i in query_ids]
        only = [self._only(places) for places in own]

        def verify(q: int, shell: Shell, some: np.ndarray) -> None:
            for row in only[q]:
                some = some[shell.rows[some] != row]
            if len(some) > k:
                rough = shell.units[some] @ units[q]
                some = some[rough >= np.partition(rough, len(some) - k)[len(some) - k] - margin]
            some = shell.rows[some]
            # Summed row by row, so that equal vectors of other blocks have the same score.
            found = (self.vectors[some].astype(np.float64) * wide[q]).sum(axis=1)
            some, found = np.append(rows[q], some), np.append(scores[q], found)
            if len(some) > k:
                # Keep all that reach the k-th best score, so that ties are not cut by chance.
                keep = found >= np.partition(found, len(found) - k)[len(found) - k]
                some, found = some[keep], found[keep]
            rows[q], scores[q] = some, found

        def cosine(q: int, most: float) -> float:
            """That of the k-th best, as it would be among vectors of this norm."""
            return scores[q].min() / norms[q] / most if len(scores[q]) >= k else -math.inf

        for shell in self.shells:
            # No vector's score is above the product of the norms.
            some = [q for q in range(len(queries)) if cosine(q, shell.most) <= 1 + 1e-9]
            if not some:
                break
            everything = np.arange(len(shell.rows))
            if len(everything) <= FEW:
                for q in some:
                    verify(q, shell, everything)
                continue
            reach = _reach(tuple(shares), shell.lines, shell.tables, collisions, sure)
            begin = 0
            for at in range(0, len(some), CHUNK):
                chunk = some[at : at + CHUNK]
                ends = []
                for q, (first, second) in zip(chunk, shell.places(units[chunk])):
                    seen = everything[:0]
                    for s in range(begin, len(shares)):
                        # A step that cannot reach enough for an answer is passed over.
                        held = shares[s] * shell.tables * len(everything)
                        if held < (k - len(scores[q])) * collisions:
                            continue
                        met = shell.met(first, second, least[s], collisions)
                        verify(q, shell, np.setdiff1d(met, seen, assume_unique=True))
                        seen = met
                        if cosine(q, shell.most) >= reach[s]:
                            break
                    else:
                        # Even the widest windows may miss some: all of them are verified.
                        verify(q, shell, np.setdiff1d(everything, seen, assume_unique=True))
                    far = cosine(q, shell.most)
                    ends.append(next((s for s, c in enumerate(reach) if far >= c), len(reach) - 1))
                # The next ones begin where half of these could have ended.
                begin = sorted(ends)[(len(ends) - 1) // 2]
        return [self._answer(own[q], rows[q], scores[q], k) for q in range(len(queries))]

    def _of_id(self, query_id: int) -> np.ndarray:
        """Places of the rows of this id."""
        first = np.searchsorted(self.ids, query_id, "left", sorter=self.by_id)
        return self.by_id[first : np.searchsorted(self.ids, query_id, "right", sorter=self.by_id)]

    def _only(self, own: np.ndarray) -> np.ndarray:
        """Vectors of which all rows are these."""
        mine, times = np.unique(self.of[own], return_counts=True)
        return mine[times == self.copies[mine]]

    def _answer(
        self, own: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray]:
        # Of a vector's rows, by rising id, the first k that are not the query's are enough.
        taken = np.minimum(self.copies[rows], k + len(own))
        places = self.by_vector[_spans(self.first[rows], taken)]
        scores = np.repeat(scores, taken)
        if len(own):
            other = self.ids[places] != self.ids[own[0]]
            places, scores = places[other], scores[other]
        ids = self.ids[places]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of vectors with finite components, not all zero."""
    good = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        & F.exists("embedding", lambda x: x != 0)
    )
    return embeddings.select("vec_id", "embedding").where(F.coalesce(good, F.lit(False)))


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    query_step: int = 20,
    tables: int = TABLES,
    shares: Sequence[float] = SHARES,
    collisions: int = COLLISIONS,
    sure: float = SURE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` nearest found.

    Queries are the rows whose ``vec_id`` is a multiple of ``query_step``, candidates all rows
    but those of the query's own id; nearness is the inner product in double precision, ties
    go to the smaller id. Only ``vec_id`` and ``embedding`` are read. Vectors that are null,
    zero, or hold a null or non-finite component take no part; only vectors of one length are
    compared. A repeated query id is answered once, repeated candidates may each be found.

    Every vector is indexed: blocks of about ``block_rows`` vectors, or 16 million components,
    dealt by a hash of the id, meet groups of queries in one task each. A block gives each query
    its ``k`` best, and the best of those are ranked. In a block equal vectors are one, and
    vectors of like norm have an index of their own, largest first. Those in the windows of
    ``collisions`` of the tables are verified; windows widen until ``k`` different vectors are
    found and one as near as the last of them would be in the windows with the chance ``sure``.
    If even the widest windows do not reach so far, the whole index is verified. The work for a
    query grows less than a block does, but in proportion to the number of blocks.
    """
    rows = usable(embeddings)
    facts = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("vec_id") % query_step == 0).alias("queries"),
        F.sum(F.size("embedding")).alias("numbers"),
    ).first()
    blocks = math.ceil(max(1, facts["n"] / block_rows, (facts["numbers"] or 0) / BLOCK_NUMBERS))
    together = min(max(query_rows, facts["queries"] / QUERY_GROUPS), QUERY_MOST)
    groups = max(1, math.ceil(facts["queries"] / together))

    dims = F.size("embedding").alias("dims")
    of_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    of_group = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(groups)).cast("int").alias("part")

    def all_of(count: int, name: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    index = rows.select(dims, of_block, all_of(groups, "part"), "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % query_step == 0).dropDuplicates(["vec_id"])
    asked = asked.select(dims, all_of(blocks, "block"), of_group, "vec_id", "embedding")

    def matrix(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
        column = table.column("embedding").combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), flat.reshape(-1, size)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": [], "vec_id": [], "score": []}
        schema = pa.schema(
            [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        )
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, schema)
        size = key[0].as_py()
        ids, vectors = matrix(left, size)
        query_ids, queries = matrix(right, size)
        # The order in which rows arrive decides nothing.
        by_id = np.argsort(query_ids, kind="stable")
        query_ids, queries = query_ids[by_id], queries[by_id]
        found = Block(ids, vectors, tables).nearest(
            query_ids, queries, k, shares, collisions, sure
        )
        parts = [(np.full(len(i), q), i, x) for q, (i, x) in zip(query_ids, found)]
        columns = [np.concatenate(x) for x in zip(*parts)]
        return pa.table(dict(zip(empty, columns)), schema)

    keys = ("dims", "block", "part")
    scored = (
        index.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
