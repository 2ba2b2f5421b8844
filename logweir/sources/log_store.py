"""The log store: ORC datasets, one per partition layout.

Layout below the root of a store::

    logs/<layout>/<partition columns>/stream_id=<id>/batch_id=<n>/*.orc
    dead_letter/stream_id=<id>/batch_id=<n>/*.orc
    commits/<id>/<n>.json            written last (see ``logweir.sources.manifest``)

The batch is the innermost level: a try of a batch that failed is overwritten by the next one,
and a query that names its time range lists only the directories of those days. Readers pass
over batches without a commit, so a batch is there in all its datasets or in none.

A compacted dataset has its own root::

    data/generation=<id>/<partition columns>/*.orc
    trigrams/generation=<id>/*.orc   (see ``logweir.sources.message_index``)
    manifest/<number>.json
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from logweir.errors import NotFoundError
from logweir.operators.filters import CALENDAR, days_of, in_calendar_range
from logweir.schemas import DEFAULT_PAYLOAD
from logweir.sources.layouts import DEFAULT_LAYOUT, STANDARD_STRATEGY, PartitionStrategy
from logweir.sources.manifest import (
    Closed,
    add_entry,
    closed_batches,
    closed_days,
    in_generations,
    live_batches,
    only_batches,
    read_commits,
    taken_days,
)
from logweir.sources.message_index import files_to_read, needed_trigrams, write_index
from logweir.sources.storage import exists, read_if_any

BATCH = ("stream_id", "batch_id")

# Names of what a commit counts beside the layouts.
DEAD_LETTER, MALFORMED = "dead_letter", "malformed"

# A range is named by path patterns up to this many; the coarser its grain, the fewer.
LISTED_PATTERNS = 64


# Fields asked for by value. A Bloom filter of each lets a reader skip groups of rows whose
# smallest and largest values enclose a value that none of them has.
LOOKED_UP = ("level", "_tag_appName", "host")
FALSE_HITS = 0.05


def layout_root(root: str, layout: str) -> str:
    return f"{root}/logs/{layout}"


def write_batch(
    rows: DataFrame, base: str, stream_id: str, batch_id: int, partition_by: tuple[str, ...]
) -> None:
    """Write one batch of one layout, replacing what an earlier try of it left."""
    levels = (*partition_by, *BATCH)
    rows = rows.withColumns(
        {"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id).cast("long")}
    )
    _write_partitions(rows, base, partition_by, levels)


def _write_partitions(
    rows: DataFrame, base: str, spread: tuple[str, ...], levels: tuple[str, ...]
) -> None:
    """Overwrite the partitions that occur in ``rows``.

    Rows are rebalanced over the partition columns: small partitions share few files, and
    adaptive execution splits a crowded one over several tasks. Within a file rows are
    sorted by time, so its statistics can answer time ranges; Bloom filters answer for the
    fields looked up by value.
    """
    held = rows.schema["data"].dataType.fieldNames()
    looked_up = ",".join(f"data.{name}" for name in LOOKED_UP if name in held)
    (
        rows.hint("rebalance", *spread)
        .sortWithinPartitions(*levels, "_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("orc.bloom.filter.columns", looked_up)
        .option("orc.bloom.filter.fpp", FALSE_HITS)
        .partitionBy(*levels)
        .orc(base)
    )


def write_dead_letters(rows: DataFrame, root: str, stream_id: str, batch_id: int) -> None:
    path = f"{root}/dead_letter/stream_id={stream_id}/batch_id={batch_id}"
    rows.hint("rebalance").write.mode("overwrite").orc(path)


def store_schema(payload: StructType = DEFAULT_PAYLOAD) -> StructType:
    return StructType(
        [
            StructField("data", payload),
            StructField("_time", TimestampType()),
            StructField("_documentType", StringType()),
            StructField("_plugin", StringType()),
            StructField("year", IntegerType()),
            StructField("month", IntegerType()),
            StructField("day", IntegerType()),
        ]
    )


def read_orc_logs(spark: SparkSession, path: str) -> DataFrame:
    """Any ORC logs of one layout, with the row type and partitions found on reading."""
    return spark.read.orc(path)


def _batch_rows(
    spark: SparkSession,
    root: str,
    layout: str,
    payload: StructType,
    strategy: PartitionStrategy,
    span: tuple[int, int] | None,
) -> DataFrame:
    """All files of one layout, with the batch each row is of."""
    stored = (
        StructType(list(store_schema(payload).fields))
        .add("stream_id", StringType())
        .add("batch_id", LongType())
    )
    return _scan(spark, layout_root(root, layout), stored, strategy.layouts[layout], span)


def read_log_store(
    spark: SparkSession,
    root: str,
    layout: str = DEFAULT_LAYOUT,
    payload: StructType = DEFAULT_PAYLOAD,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows of one layout. The row type is given, so no file is opened to plan the scan.

    Only batches that have landed in full are read. ``span`` (epoch seconds) limits which
    directories are listed, as far as the layout is partitioned by date, and leaves out batches
    without rows of these days. It is a hint: rows outside it may be returned too.
    """
    if not exists(spark, layout_root(root, layout)):
        raise NotFoundError(f"no {layout!r} logs under {root}")
    rows = _batch_rows(spark, root, layout, payload, strategy, span)
    landed = live_batches(read_commits(spark, root), [layout], span)
    return only_batches(rows, landed).select(*store_schema(payload).fieldNames())


def _scan(
    spark: SparkSession,
    path: str,
    schema: StructType,
    partition_by: tuple[str, ...],
    span: tuple[int, int] | None,
) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", path)
    pattern = span_pattern(partition_by, *span) if span else ""
    if not pattern:
        return reader.orc(path)
    found = read_if_any(reader, "orc", f"{path}/{pattern}")
    return spark.createDataFrame([], schema) if found is None else found


def span_pattern(partition_by: tuple[str, ...], start_time: int, end_time: int) -> str:
    """Path pattern of the partitions that hold the days of a range; empty without dates.

    It names days for short ranges, months for longer and years for the longest ones.
    """
    first, last = days_of(start_time, end_time)
    days = [first + timedelta(n) for n in range((last - first).days + 1)]
    dated = [c for c in partition_by if c in CALENDAR]
    if not dated or dated[0] != CALENDAR[0]:
        return ""
    for depth in range(len(dated), 0, -1):
        named = dated[:depth]
        levels = partition_by[: partition_by.index(named[-1]) + 1]
        patterns = dict.fromkeys(
            "/".join(f"{c}={getattr(day, c) if c in named else '*'}" for c in levels)
            for day in days
        )
        if len(patterns) <= LISTED_PATTERNS:
            return "{" + ",".join(patterns) + "}"
    return ""


def _layouts_there(spark: SparkSession, root: str, strategy: PartitionStrategy) -> list[str]:
    found = [name for name in strategy.layouts if exists(spark, layout_root(root, name))]
    if not found:
        raise NotFoundError(f"no logs under {root}")
    return found


def read_log_stores(
    spark: SparkSession,
    root: str,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    payload: StructType = DEFAULT_PAYLOAD,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows of all layouts that have received any."""
    found = _layouts_there(spark, root, strategy)
    return reduce(
        DataFrame.unionByName,
        [read_log_store(spark, root, name, payload, strategy, span) for name in found],
    )


def read_logs(
    spark: SparkSession,
    root: str,
    target: str,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    payload: StructType = DEFAULT_PAYLOAD,
    span: tuple[int, int] | None = None,
    through: dict[str, int] | None = None,
    keywords: Sequence[str] | str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Every landed row once: compacted days from ``target``, all else from the batches.

    Batches whose days (in ``span``) are all compacted with them are not opened; of those that
    arrived later, or have open days too, the rows that a compacted day holds are left out.
    ``through`` leaves out the batches of a stream after the given one. ``keywords`` leave out
    compacted files in which no message matches; they are a hint, as ``span`` is.
    """
    schema = store_schema(payload)
    closed = closed_days(spark, target, span)
    taken = taken_days(spark, closed)
    commits = read_commits(spark, root)
    parts = []
    if closed:
        parts.append(_compacted(spark, target, schema, strategy, span, keywords, literal))
    for layout in _layouts_there(spark, root, strategy):
        rows = _batch_rows(spark, root, layout, payload, strategy, span)
        # One row per batch, asked twice.
        live = live_batches(commits, [layout], span, taken, through)
        parts.append(only_batches(rows, live.filter("not partly")).select(*schema.fieldNames()))
        if taken is not None:
            some = only_batches(rows, live.filter("partly"))
            held = (
                (some["stream_id"] == taken["stream_id"])
                & (F.make_date(some["year"], some["month"], some["day"]) == taken["day_"])
                & (some["batch_id"] <= taken["through"])
            )
            parts.append(some.join(taken, held, "left_anti").select(*schema.fieldNames()))
    return reduce(DataFrame.unionByName, parts)


def compact_days(
    spark: SparkSession,
    root: str,
    target: str,
    start_time: int,
    end_time: int,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    payload: StructType = DEFAULT_PAYLOAD,
) -> None:
    """Rewrite whole days of all layouts as one dataset in the default layout.

    Log queries read it in place of the many small batches; it has no batch levels. The days go
    to a folder of their own, which counts once the manifest names it: running a day again takes
    in what arrived late for it, and a reader never sees half of either. Rows without a time
    belong to no day and stay where they are, as do batches after a missing one.
    """
    span = (start_time, end_time)
    through = closed_batches(read_commits(spark, root))
    rows = read_logs(spark, root, target, strategy, payload, span, through)
    generation = uuid.uuid4().hex
    days = in_calendar_range(rows, start_time, end_time)
    place = f"{target}/data/generation={generation}"
    _write_partitions(days, place, strategy.default, strategy.default)
    if "message" in payload.fieldNames():
        stored = spark.read.schema(store_schema(payload)).orc(place)
        write_index(stored, target, generation)
    add_entry(spark, target, generation, *days_of(start_time, end_time), through)


def _compacted(
    spark: SparkSession,
    target: str,
    schema: StructType,
    strategy: PartitionStrategy,
    span: tuple[int, int] | None,
    keywords: Sequence[str] | str | None = None,
    literal: bool = False,
) -> DataFrame:
    stored = StructType(list(schema.fields)).add("generation", StringType())
    levels = ("generation", *strategy.default)
    closed = closed_days(spark, target, span)
    needed = needed_trigrams(keywords, literal)
    place = f"{target}/data"
    if needed is None:
        rows = _scan(spark, place, stored, levels, span).filter(in_generations(closed))
        return rows.select(*schema.fieldNames())
    named, unread = [], []
    by_generation: dict[str, list[Closed]] = {}
    for days in closed:
        by_generation.setdefault(days.generation, []).append(days)
    for generation, days in by_generation.items():
        files = files_to_read(spark, target, generation, needed, span)
        if files is None:
            unread += days
        else:
            named += [f"{place}/generation={generation}/{f}" for f in files]
    parts = []
    if named:
        # A file may hold days that a later compaction has taken over.
        reader = spark.read.schema(stored).option("basePath", place)
        parts.append(reader.orc(named).filter(in_generations(closed)))
    if unread:
        parts.append(_scan(spark, place, stored, levels, span).filter(in_generations(unread)))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).select(*schema.fieldNames())


def read_compacted(
    spark: SparkSession,
    target: str,
    payload: StructType = DEFAULT_PAYLOAD,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    span: tuple[int, int] | None = None,
    keywords: Sequence[str] | str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Rows of a compacted dataset.

    With ``keywords`` (as a log query takes them) only files are opened whose messages hold a
    text that each match requires. It is a hint, as ``span`` is: rows that do not match may be
    returned too, so the query has to filter all the same.
    """
    if not exists(spark, f"{target}/manifest"):
        raise NotFoundError(f"no compacted logs at {target}")
    schema = store_schema(payload)
    return _compacted(spark, target, schema, strategy, span, keywords, literal)


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Messages that named no document type or no plugin."""
    schema = StructType(
        [
            StructField("_raw", StringType()),
            StructField("_documentType", StringType()),
            StructField("_plugin", StringType()),
            StructField("stream_id", StringType()),
            StructField("batch_id", LongType()),
        ]
    )
    path = f"{root}/dead_letter"
    if not exists(spark, path) or not exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], schema)
    landed = live_batches(read_commits(spark, root), [DEAD_LETTER, MALFORMED])
    return only_batches(spark.read.schema(schema).orc(path), landed)
