"""N-gram Jaccard join by prefixes under several global orders of the shingles.

Two sets that are alike share a member among the first few of each, under any order of all
members. Pairs come from the order of rising frequency, are kept if their prefixes also meet
under the order of rising and of falling hash, and only then are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweir.llm.components import components
from logweir.llm.shingles import shingle_sets
from logweir.llm.tables import Scratch
from logweir.llm.words import CHUNK_ROWS, forget, hash_parts, sent, slices

# Shingles counted together in one task, before they are dealt out by hash.
CHUNK_SHINGLES = 1_000_000
# Groups of up to so many sets are paired whole; of larger ones, so many meet all the others
# in each of the first rounds.
GROUP = 24
LEADERS = 2
# Ids of documents worth a comparison are broadcast up to this count, and joined beyond it.
BROADCAST_IDS = 1_000_000

# Slots of the parities of a set; two sets differ in at least as many members as slots.
SLOTS = 1024

_VALUE_BITS = np.uint64(40)


def _shared_counts(
    docs: DataFrame, width: int, parts: int, chunk_shingles: int
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``n_shared``: how many are in another document too.

    Shingles are counted by hash part. A task first counts within a chunk of documents: what
    two of them share is settled there, and each shingle leaves the chunk once, as 40 bits
    within its part. So a shingle of a third of all documents is as many values as there are
    chunks. Beside each stands the number of its document within the chunk, and the answer is
    the numbers of those found again: both are as long as the shingles, whatever the parts. Two shingles taken for one can only keep a document for comparison.
    """

    columns = pa.schema(
        [("part", pa.int64()), ("chunk", pa.int64())]
        + [(n, pa.binary()) for n in ("owners", "low", "high")]
        + [(n, pa.list_(pa.int64())) for n in ("ids", "sizes", "shared")]
    )

    def rows_of(chunk: int, ids: list, sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        times = np.diff(np.append(np.flatnonzero(first), len(ranked)))
        alone = np.repeat(times, times) == 1
        local = np.bincount(owner[order[~alone]], minlength=len(sets))
        values, owners = ranked[first], owner[order[first]]
        # Shared ones need no answer: they belong to nobody.
        owners = np.where(times == 1, owners, len(sets))
        # Sorted by hash already; the parts are runs of them.
        part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        values = mixed_low(values)
        for k in np.unique(part).tolist():
            some = slice(cuts[k], cuts[k + 1])
            by_owner = np.argsort(owners[some], kind="stable")
            held = values[some][by_owner]
            # Behind the owned ones are those that belong to nobody.
            own = owners[some][by_owner]
            yield (
                k,
                chunk,
                own[: np.searchsorted(own, len(sets))].astype("<u2").tobytes(),
                (held & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                (held >> np.uint64(32)).astype("u1").tobytes(),
                None,
                None,
                None,
            )
        # The chunk's own documents travel under a key of their own.
        yield -1 - chunk, chunk, b"", b"", b"", ids, sizes, local

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        chunk = TaskContext.get().partitionId() << 24
        ids, sets, held = [], [], 0
        for batch in slices(batches):
            ids += batch.column("doc_id").to_pylist()
            sets += (found := shingle_sets(batch.column("text"), width))
            held += sum(map(len, found))
            if held >= chunk_shingles or len(ids) >= CHUNK_ROWS:
                yield from sent(rows_of(chunk, ids, sets), columns)
                chunk, ids, sets, held = chunk + 1, [], [], 0
        if ids:
            yield from sent(rows_of(chunk, ids, sets), columns)

    def count(table: pa.Table) -> pa.Table:
        names = ["chunk", "ids", "sizes", "shared"]
        schema = pa.schema(
            [("chunk", pa.int64()), *((n, pa.list_(pa.int64())) for n in names[1:-1])]
            + [("shared", pa.binary())]
        )
        if table["part"][0].as_py() < 0:
            shared = [
                np.repeat(np.arange(len(x)), x).astype("<u2").tobytes()
                for x in table["shared"].to_pylist()
            ]
            packed = pa.array(shared, pa.binary())
            return pa.table([table["chunk"], table["ids"], table["sizes"], packed], schema)
        owners = [np.frombuffer(x.as_py(), "<u2") for x in table["owners"]]
        totals = [len(x.as_py()) for x in table["high"]]
        low = np.frombuffer(b"".join(table["low"].to_pylist()), "<u4")
        high = np.frombuffer(b"".join(table["high"].to_pylist()), "u1").astype(np.uint64)
        values = low | (high << np.uint64(32))
        order = np.argsort(values)
        ranked = values[order]
        edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))[: len(ranked)]
        times = np.diff(np.append(edge, len(ranked)))
        again = np.empty(len(ranked), bool)
        again[order] = np.repeat(times > 1, times)
        answers, at = [], 0
        for own, total in zip(owners, totals):
            answers.append(own[again[at : at + len(own)]].tobytes())
            at += total
        nothing = pa.nulls(len(answers), pa.list_(pa.int64()))
        return pa.table([table["chunk"], nothing, nothing, pa.array(answers, pa.binary())], schema)

    def gather(table: pa.Table) -> pa.Table:
        known = next(k for k, x in enumerate(table["ids"]) if x.is_valid)
        ids, sizes = (table[n][known].values for n in ("ids", "sizes"))
        found = np.frombuffer(b"".join(table["shared"].to_pylist()), "<u2")
        total = np.bincount(found, minlength=len(ids))
        return pa.table({"doc_id": ids, "n_shingles": sizes, "n_shared": total})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        deal,
        "part long, chunk long, owners binary, low binary, high binary, "
        "ids array<long>, sizes array<long>, shared array<long>",
    )
    counted = dealt.groupBy("part").applyInArrow(
        count, "chunk long, ids array<long>, sizes array<long>, shared binary"
    )
    return counted.groupBy("chunk").applyInArrow(
        gather, "doc_id long, n_shingles long, n_shared long"
    )


def mixed_low(values: np.ndarray) -> np.ndarray:
    """40 bits of each hash that its part does not already fix."""
    return values & ((np.uint64(1) << _VALUE_BITS) - np.uint64(1))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            ends = np.append(0, np.cumsum([len(s) for s in sets]))
            flat = np.concatenate(sets).view(np.int64)
            members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            signs = pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), members, signs], names=["doc_id", "members", "signs"]
            )

    return docs.mapInArrow(find, "doc_id long, members array<long>, signs array<long>")


def _parities(members: np.ndarray) -> np.ndarray:
    """For each of many slots, whether an odd number of members falls into it."""
    odd = np.bincount((members % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(n: Column, percent: int) -> Column:
    """Length of the prefix in which alike sets must meet."""
    return (n - F.ceil(n * percent / F.lit(100.0)) + 1).cast("int")


def ngram_classes(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    parts: int | None = None,
    chunk_shingles: int = CHUNK_SHINGLES,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their sets of ``width``-word
    shingles; ``component_id`` is the smallest id reachable by links. Reads ``doc_id`` (an
    integer) and ``text``. A null, empty or blank text has no shingles and no links; rows of
    one id are one node; a row without id has no component. Equality is that of 64-bit hashes.

    1. A document can only be alike to another if ``percent`` of its shingles occur elsewhere;
       one count over all shingles leaves the few such documents.
    2. Equal sets become one class, by an aggregation, and the same count is repeated on them.
    3. Classes that share a shingle of their prefix, in order of rising frequency, form a
       group. Small groups are paired. In a large one a few members meet all others, as long
       as that links any; in the end all outside its largest component meet the rest. So a
       group of near copies takes about a comparison per member, and no pair of classes of two
       components is left out.
    4. Pairs of fitting sizes whose prefixes also meet under two orders by hash are compared.
    """
    scratch = Scratch("ngram-join")
    if parts is None:
        parts = hash_parts(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counted = scratch.write(_shared_counts(docs, width, parts, chunk_shingles))
    hopeful = counted.where(
        (F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
        & (F.col("n_shingles") > 0)
        & F.col("doc_id").isNotNull()
    ).select("doc_id").distinct()
    hopeful = scratch.write(hopeful)
    ids = F.broadcast(hopeful) if hopeful.count() <= BROADCAST_IDS else hopeful
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = named.join(ids, "doc_id", "left_semi")
    sets = scratch.write(
        _sets(some, width).withColumns(
            {"mark": F.xxhash64("members"), "mark2": F.hash("members"), "n": F.size("members")}
        )
    )
    key = ["mark", "mark2", "n"]
    named = sets.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = sets.join(named, key).select("doc_id", "rep").distinct()
    # One row per class: the first of the rows that share its smallest id.
    classes = scratch.write(
        sets.join(named, key)
        .where("doc_id = rep")
        .groupBy("rep", *key)
        .agg(F.first("members").alias("members"), F.first("signs").alias("signs"))
        .withColumn("node", F.xxhash64("rep", "mark"))
        .select("node", "rep", "n", "signs", F.array_sort("members").alias("members"))
    )
    links = _links(classes, percent, scratch)
    of_class = classes.select(F.col("node"), F.col("rep"))
    a, b = of_class.alias("a"), of_class.alias("b")
    linked = (
        links.join(a, F.col("l") == F.col("a.node"))
        .join(b, F.col("r") == F.col("b.node"))
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    )
    edges = linked.union(members.where("doc_id <> rep").select("doc_id", "rep"))
    grouped = scratch.write(components(edges, scratch))
    scratch.drop(hopeful, classes, sets)
    return counted.join(grouped, counted["doc_id"] == grouped["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _links(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs ``l``, ``r`` of alike classes that connect all that alike classes connect."""
    each = classes.select("node", "n", F.explode("members").alias("member"))
    often = each.groupBy("member").agg(F.count("*").alias("df")).where("df > 1")
    # A class of which too much is nowhere else can be left out before any grouping.
    shared = each.join(often, "member").groupBy("node").agg(
        F.first("n").alias("n"),
        F.count("*").alias("shared"),
        F.array_sort(F.collect_list(F.struct("df", "member"))).alias("rising"),
    )
    # Members found nowhere else come first in the order and take up the prefix.
    room = _prefix(F.col("n"), percent) - (F.col("n") - F.col("shared"))
    fitting = shared.where(F.col("shared") * 100 >= F.col("n") * percent)
    groups = fitting.select(
        "node",
        "n",
        F.col("shared").alias("held"),
        F.explode(F.slice("rising", F.lit(1), room)).alias("m"),
    ).select("node", "n", "held", F.col("m.member").alias("member"))
    groups = scratch.write(groups)
    # Whoever has too many members of its own even for the smallest of a group has no pair there.
    smallest = groups.groupBy("member").agg(F.min("n").alias("least"))
    kept = groups.join(smallest, "member").where(
        F.col("held") * (100 + percent) >= (F.col("n") + F.col("least")) * percent
    )
    signs = classes.select("node", "signs")
    alone = {"component": F.col("node"), "weight": F.lit(1).cast("long")}
    open_ = scratch.write(kept.drop("least").join(signs, "node").withColumns(alone))
    scratch.drop(groups)
    links = scratch.write(classes.select(F.col("node").alias("l"), F.col("node").alias("r")).limit(0))
    star = True
    while True:
        # Groups that are connected already, and those of one, are done.
        parts = open_.groupBy("member", "component").agg(F.count("*").alias("part"))
        groups = parts.groupBy("member").agg(
            F.sum("part").alias("size"),
            F.max_by("component", F.struct("part", "component")).alias("largest"),
            F.count("*").alias("parts"),
        )
        entries = scratch.write(open_.join(groups.where("parts > 1"), "member"))
        if entries.isEmpty():
            break
        small = entries.where(F.col("size") <= GROUP)
        large = entries.where(F.col("size") > GROUP)
        if star:
            # First those that are alone, and of these the ones with the least of their own.
            own = F.col("held") / F.col("n")
            turn = Window.partitionBy("member").orderBy("weight", own.desc(), "node")
            lead = large.withColumn("turn", F.row_number().over(turn))
            lead = lead.where(F.col("turn") <= LEADERS)
        else:
            lead = large.where("component <> largest")
        pairs = _pairs(small, small, percent).union(_pairs(lead, large, percent)).distinct()
        alike = scratch.write(_verified(pairs, classes, percent))
        found = scratch.write(links.union(alike))
        stop = not star
        star = not alike.isEmpty()
        scratch.drop(links, alike)
        links = found
        if stop:
            break
        labels = components(links.select(F.col("l").alias("a"), F.col("r").alias("b")), scratch)
        weights = labels.groupBy("component").agg(F.count("*").alias("weight"))
        labels = scratch.write(labels.join(weights, "component"))
        following = large.select("node", "n", "held", "member", "signs").join(labels, "node", "left")
        following = scratch.write(
            following.withColumns(
                {
                    "component": F.coalesce("component", "node"),
                    "weight": F.coalesce("weight", F.lit(1)),
                }
            )
        )
        scratch.drop(open_, entries, labels)
        open_ = following
    return links


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Members of one group, of two components, that can be alike; smaller node first.

    They have no more in common than either has members that occur elsewhere, and differ in
    no fewer than their parities do.
    """
    a, b = F.col("a_signs"), F.col("b_signs")
    apart = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SLOTS // 64)), F.lit(0))

    def named(df: DataFrame, name: str) -> DataFrame:
        columns = ("node", "n", "held", "component", "signs")
        return df.select("member", *(F.col(c).alias(name + c) for c in columns))

    met = named(left, "a_").join(named(right, "b_"), "member").where(
        (F.col("a_node") != F.col("b_node"))
        & (F.col("a_component") != F.col("b_component"))
        & (
            F.least("a_held", "b_held") * (100 + percent)
            >= (F.col("a_n") + F.col("b_n")) * percent
        )
        & (apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent))
    )
    return met.select(
        F.least("a_node", "b_node").alias("l"), F.greatest("a_node", "b_node").alias("r")
    )


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    a = classes.select(F.col("node").alias("l"), F.col("members").alias("ls"), F.col("n").alias("ln"))
    b = classes.select(F.col("node").alias("r"), F.col("members").alias("rs"), F.col("n").alias("rn"))
    lp, rp = _prefix(F.col("ln"), percent), _prefix(F.col("rn"), percent)
    rising = F.arrays_overlap(F.slice("ls", F.lit(1), lp), F.slice("rs", F.lit(1), rp))
    falling = F.arrays_overlap(F.slice("ls", -lp, lp), F.slice("rs", -rp, rp))
    both = pairs.join(a, "l").join(b, "r").where(rising & falling)
    common = F.size(F.array_intersect("ls", "rs"))
    return (
        both.withColumn("common", common)
        .where(F.col("common") * 100 >= (F.col("ln") + F.col("rn") - F.col("common")) * percent)
        .select("l", "r")
    )


def _without(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by ``doc_id``; ids are broadcast up to a checked count."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def one_per_class(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the smallest id of each class of alike documents.

    Of several rows with that id one is kept; rows without id all stay.
    """
    scratch = Scratch("one-per-class")
    classes = scratch.write(ngram_classes(docs, width, percent))
    repeated = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeated = scratch.write(repeated.select("doc_id"))
    later = classes.where("doc_id <> component_id").select("doc_id").distinct()
    kept = _without(docs, later, "left_anti")
    if repeated.isEmpty():
        return kept
    single = _without(kept, repeated, "left_anti")
    return single.union(_without(kept, repeated, "left_semi").dropDuplicates(["doc_id"]))
