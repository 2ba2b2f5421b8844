"""Mixing sources to target weights along a curriculum.

The weight of a source changes over training time 0..1. Its integral is the share of the
source's target demanded up to a time; inverting it at the words already taken gives the
training position of a document, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.tables import free_name

WEIGHTS = (5.0, 2.0, 1.0)
# Knots (time, relative weight) of piecewise linear schedules, one per entry of WEIGHTS:
# the first kind of source grows, the last fades.
SCHEDULES = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
)
SHARE = 1.5
MOST = 2.0
# Sources are ordered in so many buckets each, so that a source of a third of all rows is
# summed by as many tasks.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but blanks; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def training_time(demanded: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which a share 0..1 of the demand has been asked for: the inverse integral."""
    areas = [
        (t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])
    ]
    total = sum(areas)
    found, before = F.lit(schedule[-1][0]), total
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(schedule, schedule[1:]), areas))):
        before -= area
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(demanded * F.lit(total) - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.lit(w0 * w0) + rest * F.lit(2 * slope))
        inside = F.lit(t0) + rest * F.lit(2.0) / (F.lit(w0) + root)
        found = F.when(demanded * F.lit(total) < F.lit(before + area), inside).otherwise(found)
    return found


def _taken_at(schedule: Sequence[tuple[float, float]]) -> Callable[[Column], Column]:
    def time(turn: Column) -> Column:
        before = F.col("offset") + turn * F.col("source_size")
        return training_time(before / F.col("demand"), schedule)

    return time


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``kind`` from rows of source and size.

    Weights go round over the sources by code point, null last. Targets share ``share`` times
    all sizes by weight; one that would pass ``most`` times its source is held there and the
    rest is shared again. In order of size per weight the held sources come first, so one
    running sum finds them. One row per source passes through one task, never the documents.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(named) - 1) % len(weights)
    rows = summed.withColumn("kind", kind).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1)
    )
    cap = F.col("source_size") * F.lit(most)
    tight = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (
            F.sum("source_size").over(whole) * F.lit(share)
            - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
        )
        / F.sum("weight").over(after),
    )
    rows = rows.withColumn("held", F.col("level") * F.col("weight") > cap)
    level = F.first(F.when(~F.col("held"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when(F.col("held"), cap).otherwise(level * F.col("weight")).cast("double")
    return rows.select("source", "source_size", target.alias("target"), "kind")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """How much of each document the mix takes, and when: one row per row of ``docs``.

    Reads ``doc_id``, ``text`` and ``source``; other columns may have any name. Returns
    ``doc_id``, ``size`` (words, 0 of null), ``source_size``, ``target``, ``taken`` and
    ``positions``, range-sorted by the first position, then doc_id.

    The documents of a source stand in a ring, ordered by the MD5 of their id, or of their text
    where they have none. Its rounded target is taken from the start of the ring, going round
    again where it is larger than the source; so ``taken`` sums to it exactly. ``positions`` has
    the training time 0..1 of each taking: when the schedule of the source has demanded the words
    before it; it is empty where nothing is taken. A null source is a source of its own, equal rows are taken in turn, and an
    empty table gives an empty result. ``share`` may not exceed ``most``.
    """
    rows = _mixed(docs, weights, schedules, share, most, buckets)
    mixed = rows.select("doc_id", "size", "source_size", "target", "taken", "positions").withColumn(
        "position", F.try_element_at("positions", F.lit(1))
    )
    ordered = mixed.repartitionByRange("position", "doc_id").sortWithinPartitions(
        "position", "doc_id"
    )
    return ordered.drop("position")


def _mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
    buckets: int = BUCKETS,
    whole: bool = False,
) -> DataFrame:
    """The columns of ``mix`` in no order; ``whole`` adds each row of ``docs`` as ``document``."""
    # Rows without an id are dealt by their text.
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    # A source as a key that is never null, so that rows are dealt out once for sums and plan.
    known = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    carried, order = [], ["digest", "doc_id", "size"]
    if whole:
        # Rows of one id and size stand in an order that a repeated task finds again.
        plain = [n for n, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
        carried = [
            F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("document"),
            F.xxhash64(*(F.col(f"`{n}`") for n in plain)).alias("tie"),
        ]
        order.append("tie")
    rows = docs.select(
        "doc_id",
        known.alias("known"),
        word_count(F.col("text")).alias("size"),
        digest.alias("digest"),
        *carried,
    ).withColumn(
        "bucket", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets
        / F.lit(2**32)
    ).withColumn("bucket", F.floor("bucket").cast("int"))
    # Sums read no more than ids, sources and words.
    sums = rows.groupBy("known", "bucket").agg(F.sum("size").alias("size")).withColumn(
        "source",
        F.when(F.col("known") != "", F.substring("known", 2, 2**31 - 1)).cast(
            docs.schema["source"].dataType
        ),
    )
    ring = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = sums.select(
        "source",
        F.col("known"),
        F.col("bucket"),
        F.coalesce(F.sum("size").over(ring), F.lit(0)).alias("base"),
    )
    targets = source_targets(sums, weights, share, most)
    targets = targets.withColumnRenamed("source", "s")
    plan = based.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source", "s")
    inside = (
        Window.partitionBy("known", "bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(plan, ["known", "bucket"])
    demand = F.floor(F.col("target") + 0.5)
    offset = F.col("base") + F.col("inside")
    rows = rows.withColumns({"demand": demand, "offset": offset}).withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(0)
    )
    rest = F.col("demand") - F.col("rounds") * F.col("source_size") - F.col("offset")
    part = F.greatest(F.least(rest, F.col("size")), F.lit(0))
    rows = rows.withColumn("taken", (F.col("rounds") * F.col("size") + part).cast("long"))
    times = F.lit(None).cast("array<double>")
    takes = F.when(F.col("taken") > 0, F.expr("cast(ceil(taken / size) as int)"))
    for k in range(len(weights)):
        each = F.transform(F.sequence(F.lit(0), takes - 1), _taken_at(schedules[k]))
        times = F.when(F.col("kind") == k, each).otherwise(times)
    times = F.coalesce(times, F.array().cast("array<double>"))
    return rows.withColumn("positions", times)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in the order of training.

    A document comes once per taking, a last part of it if that is half of it or more, since
    documents are not cut here; one of which less is taken goes. Each row comes by its own
    takings, whatever its id: rows without one or of the same id are not told apart by it.
    """
    at = free_name(docs, "mixed_at")
    whole = F.round(F.try_divide("taken", "size")).cast("int")
    times = F.explode(F.slice("positions", F.lit(1), whole))
    rows = _mixed(docs, **options, whole=True).select("document", times.alias(at)).select(
        "document.*", at
    )
    ordered = rows.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id")
    return ordered.select(docs.columns)
