"""Parts of a sorted table: their metadata, their offsets and which of them a range meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.errors import ValidationError
from logweir.operators.filters import check_range

MODES = ("Offset", "Timestamp")

# monotonically_increasing_id() keeps the partition number above these bits.
_ROW_BITS = (1 << 33) - 1

# Ranges of one sort, each with about a hundred rows of Spark's sample; and the numbers there are
# for the parts of a range where it has several.
MOST_RANGES = 10_000
PARTS_OF_RANGE = 1 << 17

# A part index up to this many rows (three longs each) is broadcast, a longer one is not.
BROADCAST_PARTS = 100_000


def number_rows(
    rows: DataFrame,
    parts: int,
    order_by: list[str | Column],
    rows_per_part: int | None = None,
) -> DataFrame:
    """Sort into ``parts`` ranges and give each row its ``part_id`` and ``local_idx``.

    Ranges need no count of earlier rows, so no row passes through a single task; absolute
    offsets follow from the per-part counts (:func:`offset_index`). ``order_by`` has to end
    in something unique, which also lets a run of equal keys spread over several parts.
    The part number leads the sort only so that a write partitioned by it finds its rows
    in the order it needs and does not sort again.

    Spark bounds the sample that all ranges of a sort share, so beyond ``MOST_RANGES`` ranges
    would come out ever more uneven. There are no more then; each is cut into parts of exactly
    ``rows_per_part`` (but for its last) by the places of its sorted rows.
    """
    ranges = min(parts, MOST_RANGES) if rows_per_part else parts
    numbered = (
        rows.repartitionByRange(ranges, *order_by)
        .withColumn("part_id", F.spark_partition_id())
        .sortWithinPartitions("part_id", *order_by)
        .withColumn("local_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    if ranges == parts:
        return numbered
    inside = F.floor(F.col("local_idx") / F.lit(rows_per_part))
    return numbered.withColumns(
        {
            "part_id": (F.col("part_id") * F.lit(PARTS_OF_RANGE) + inside).cast("int"),
            "local_idx": F.col("local_idx") % F.lit(rows_per_part),
        }
    )


def part_metadata(rows: DataFrame, part: str = "part_id", *more: Column) -> DataFrame:
    """Count, first and last timestamp of each part, and ``more``, in one aggregation."""
    return rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("startTimestamp"),
        F.max("timestamp").alias("endTimestamp"),
        *more,
    )


def offset_index(parts: DataFrame, order: str = "part_id") -> DataFrame:
    """Replace ``count`` by 0-based inclusive ``startOffset`` and ``endOffset``.

    The window has no partition key: it runs over one row per part, never over log rows.
    """
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("count").over(running)
    return (
        parts.withColumn("endOffset", end - 1)
        .withColumn("startOffset", F.col("endOffset") - F.col("count") + 1)
        .drop("count")
    )


def overlapping_parts(parts: DataFrame, start: int, end: int, mode: str) -> DataFrame:
    """Parts that meet ``[start, end]``, their bounds clipped to it.

    ``mode`` names the bounds: ``Offset`` or ``Timestamp``. Parts without bounds never match.
    """
    if mode not in MODES:
        raise ValidationError(f"invalid mode: {mode!r}")
    check_range(start, end)
    low, high = f"start{mode}", f"end{mode}"
    return parts.filter((F.col(high) >= start) & (F.col(low) <= end)).withColumns(
        {
            low: F.greatest(F.col(low), F.lit(start).cast("long")),
            high: F.least(F.col(high), F.lit(end).cast("long")),
        }
    )


def total_rows(index: DataFrame) -> int:
    """Rows of all parts together, from the last offset."""
    return index.agg(F.coalesce(F.max("endOffset") + 1, F.lit(0))).first()[0]


def add_offset(rows: DataFrame, index: DataFrame, index_rows: int) -> DataFrame:
    """Absolute 0-based ``offset`` of each row, from the base offset of its part.

    ``index_rows`` is the checked length of ``index``: a short one is broadcast, a long one
    joined on the part number as Spark sees fit (parts are of about equal size).
    """
    bases = index.select("part_id", F.col("startOffset").alias("_base"))
    if index_rows <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    return (
        rows.join(bases, "part_id")
        .withColumn("offset", F.col("_base") + F.col("local_idx"))
        .drop("_base")
    )
