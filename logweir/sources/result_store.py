"""Stored query results.

Layout below the path of a result::

    attempt-<id>/result/part_id=<k>/*.orc   rows sorted by time within and across parts
    attempt-<id>/meta/                      one JSON row per part: count, first, last timestamp
    attempt-<id>/index/                     one ORC row per part: its offsets and timestamps
    commit/commit.json           one JSON row, written last: attempt, rows, row type
    slices/<id>/chunk_id=<k>/    rows of an exported time slice in chunks of fixed size
    slices/<id>_index/           one JSON row per chunk, written last: its positions

Readers find the attempt through the commit, so a result is there as a whole or not at all.
What a job that died has left is never read, and does not stand in the way of another.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from logweir.errors import IncompleteResultError, NotFoundError, ValidationError
from logweir.functions.columns import base_name
from logweir.operators.filters import check_positive, check_range, in_time_slice
from logweir.operators.parts import (
    add_offset,
    number_rows,
    offset_index,
    part_metadata,
)
from logweir.schemas import CHUNK_INDEX, PART_INDEX, PART_METADATA, RESULT_COMMIT
from logweir.sources.storage import (
    count_stored,
    exists,
    footers,
    read_if_any,
    staged,
    write_new,
)

ROWS_PER_PART = 1_000_000
ROWS_PER_CHUNK = 100_000

# A page names the directories it reads up to this many.
LISTED_DIRECTORIES = 64

# A page of up to this many rows is sorted as a top-k, in one task.
TOP_ROWS = 100_000

COMMIT_FILE = "commit/commit.json"
SEQUENCE = "_row_sequence"
_STORED = ("local_idx", "part_id")


# ---------------------------------------------------------------- writing


def with_sequence(rows: DataFrame) -> DataFrame:
    """Number rows in scan order, as the last word on the order of rows with equal keys."""
    return rows.withColumn(SEQUENCE, F.monotonically_increasing_id())


def write_result(
    rows: DataFrame,
    path: str,
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> int:
    """Store ``rows`` sorted by ``timestamp`` (nulls first) and return how many there are.

    ``rows`` is evaluated once, into a staged table that also fixes the order of rows with
    equal keys; counting, sampling for the ranges and sorting then read only the matches.
    """
    check_positive("rows_per_part", rows_per_part)
    check_absent(rows.sparkSession, path)
    with staged(with_sequence(rows), "matches") as matches:
        return write_staged(matches, path, tie_breakers, rows_per_part)


def check_absent(spark: SparkSession, path: str) -> None:
    if _is_committed(spark, path):
        raise ValidationError(f"result exists already: {path}")


def _is_committed(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{COMMIT_FILE}")


def write_staged(
    matches: DataFrame,
    path: str,
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> int:
    """Store a staged table made by :func:`with_sequence`."""
    spark = matches.sparkSession
    total = count_stored(matches)
    parts = max(1, ceil(total / rows_per_part))
    order = ["timestamp", *tie_breakers, SEQUENCE]
    sorted_rows = number_rows(matches, parts, order, rows_per_part).drop(SEQUENCE)
    payload = matches.drop(SEQUENCE).schema

    attempt = f"attempt-{uuid.uuid4().hex}"
    base = f"{path}/{attempt}"
    sorted_rows.write.mode("errorifexists").partitionBy("part_id").orc(f"{base}/result")
    # From the footers of the written files: a second run of the plan could sample other
    # ranges, and the rows need not be read again.
    timed = F.count("timestamp").alias("timed")
    written = _stored_rows(footers(spark), base, payload)
    metadata = part_metadata(written, "part_id", timed).select(
        F.concat(F.lit(f"{base}/result/part_id="), F.col("part_id")).alias("partName"),
        F.col("part_id").cast("long").alias("part_id"),
        "count",
        "timed",
        "startTimestamp",
        "endTimestamp",
    )
    # One row per part, in one file; the rows of the parts are aggregated before.
    metadata.drop("timed").repartition(1).write.json(f"{base}/meta")
    index = offset_index(metadata.withColumn("whole", F.col("timed") == F.col("count")))
    index.drop("timed").write.orc(f"{base}/index")
    held = spark.read.schema(PART_METADATA).json(f"{base}/meta").agg(F.sum("count")).first()[0]
    if (held or 0) != total:
        raise IncompleteResultError(f"{held} of {total} rows were stored below {base}")
    facts = {"attempt": attempt, "value": total, "schema": payload.json()}
    if not write_new(spark, f"{path}/{COMMIT_FILE}", json.dumps(facts) + "\n"):
        raise ValidationError(f"another run has stored a result meanwhile: {path}")
    return total


def _one_row(spark: SparkSession, column) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(column)


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Commit:
    """The attempt whose files are the result, its number of rows and their type."""

    base: str
    total: int
    schema: StructType

    @property
    def mark(self) -> str:
        return self.base.rpartition("attempt-")[2][:12]


def read_commit(spark: SparkSession, path: str) -> Commit:
    if not _is_committed(spark, path):
        raise NotFoundError(f"no result at {path}")
    row = json.loads(spark.read.text(f"{path}/commit").first()[0])
    return Commit(
        f"{path}/{row['attempt']}", row["value"], StructType.fromJson(json.loads(row["schema"]))
    )


def _stored_rows(
    spark: SparkSession, base: str, payload: StructType, parts: Sequence[int] | None = None
) -> DataFrame:
    stored = (
        StructType(list(payload.fields))
        .add("local_idx", LongType())
        .add("part_id", IntegerType())
    )
    reader = spark.read.schema(stored).option("basePath", f"{base}/result")
    return reader.orc(_directories(f"{base}/result", "part_id", parts))


def _directories(base: str, level: str, numbers: Sequence[int] | None) -> str:
    """Path pattern of numbered directories; many of them are left to the filter.

    Naming the few directories of a page keeps its cost apart from the size of the result,
    whose directories would all be listed otherwise.
    """
    if numbers is None or len(numbers) > LISTED_DIRECTORIES:
        return base
    return f"{base}/{level}={{{','.join(map(str, numbers))}}}"


def read_parts(spark: SparkSession, path: str, part_ids: list[int] | None = None) -> DataFrame:
    """Rows of a result, or of the named parts only."""
    commit = read_commit(spark, path)
    if not part_ids:
        rows = _stored_rows(spark, commit.base, commit.schema)
        return rows if part_ids is None else rows.limit(0)
    rows = _stored_rows(spark, commit.base, commit.schema, part_ids)
    return rows.filter(F.col("part_id").isin(part_ids))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Part metadata of a result; no rows when the result has none."""
    return spark.read.schema(PART_METADATA).json(f"{read_commit(spark, path).base}/meta")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value``: the stored row count, 0 when there is no result."""
    total = read_commit(spark, path).total if _is_committed(spark, path) else 0
    return _one_row(spark, F.lit(total).cast("long").alias("value"))


def read_job_statistics(spark: SparkSession, root: str, query_type: str) -> DataFrame:
    """``jobId`` and ``totalRowCount`` of every stored result of a query type under a root."""
    commits = read_if_any(
        spark.read.schema(RESULT_COMMIT), "json", f"{root}/*_{query_type}/commit"
    )
    folder = base_name(F.regexp_replace(F.col("_metadata.file_path"), "/commit/[^/]*$", ""))
    if commits is None:
        return spark.createDataFrame([], "jobId string, totalRowCount long")
    suffix = len(query_type) + 1
    return (
        commits.select(folder.alias("folder"), "value")
        .groupBy(F.col("folder").substr(F.lit(1), F.length("folder") - suffix).alias("jobId"))
        .agg(F.coalesce(F.max("value"), F.lit(0)).alias("totalRowCount"))
    )


def part_index(spark: SparkSession, path: str) -> DataFrame:
    """First and last offset and timestamp of each part, as stored with the result."""
    return _index(spark, read_commit(spark, path))


def _index(spark: SparkSession, commit: Commit) -> DataFrame:
    index = spark.read.schema(PART_INDEX).orc(f"{commit.base}/index")
    return index.withColumn("partName", base_name(F.col("partName")))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a result with their 1-based ``offset``, in no particular order."""
    commit = read_commit(spark, path)
    index = _index(spark, commit)
    rows = _stored_rows(spark, commit.base, commit.schema)
    return _page_columns(add_offset(rows, index, index.count()))


def _page_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("offset", F.col("offset") + 1).drop(*_STORED)


def _with_offset(
    spark: SparkSession, commit: Commit, hit: DataFrame, local: Column | None = None
) -> DataFrame | None:
    """Rows with ``offset`` of the parts in ``hit``; ``None`` when there are none.

    A few parts come to the driver as one row each: their directories are named, their base
    offsets become literals, and ``local`` positions are pushed to the ORC reader. A long run
    of parts is joined with the stored index instead.
    """
    few = hit.select("part_id", "startOffset").limit(LISTED_DIRECTORIES + 1).collect()
    if not few:
        return None
    if len(few) > LISTED_DIRECTORIES:
        met = hit.agg(F.min("part_id"), F.max("part_id"), F.count(F.lit(1))).first()
        rows = _stored_rows(spark, commit.base, commit.schema)
        return add_offset(rows.filter(F.col("part_id").between(met[0], met[1])), hit, met[2])
    numbers = [row["part_id"] for row in few]
    rows = _stored_rows(spark, commit.base, commit.schema, numbers)
    rows = rows.filter(F.col("part_id").isin(numbers))
    if local is not None:
        rows = rows.filter(local)
    bases = F.lit(None).cast("long")
    for row in few:
        bases = F.when(F.col("part_id") == row["part_id"], row["startOffset"]).otherwise(bases)
    return rows.withColumn("offset", bases + F.col("local_idx"))


def _no_rows(spark: SparkSession, commit: Commit) -> DataFrame:
    schema = StructType(list(commit.schema.fields)).add("offset", LongType())
    return spark.createDataFrame([], schema)


def offset_page(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` of a result, 1-based and inclusive, in order.

    The filter on the stored offsets is pushed into the part index, and a page in one part
    names the positions it reads: what a page costs does not grow with the result.
    """
    check_positive("start", start)
    check_range(start, end)
    return _offset_page(spark, read_commit(spark, path), start, end)


def _offset_page(spark: SparkSession, commit: Commit, start: int, end: int) -> DataFrame:
    index = _index(spark, commit)
    hit = index.filter((F.col("endOffset") >= start - 1) & (F.col("startOffset") <= end - 1))
    met = hit.select("startOffset").limit(2).collect()
    local = None
    if len(met) == 1:
        base = met[0]["startOffset"]
        local = F.col("local_idx").between(start - 1 - base, end - 1 - base)
    rows = _with_offset(spark, commit, hit, local)
    if rows is None:
        return _no_rows(spark, commit)
    page = rows.filter(F.col("offset").between(start - 1, end - 1))
    return _in_order(_page_columns(page), end - start + 1)


def _in_order(page: DataFrame, size: int) -> DataFrame:
    """Sort a page of at most ``size`` rows.

    The limit drops nothing; it has a short page sorted in one pass, where a range sort
    would read it once more to sample it.
    """
    ordered = page.orderBy("offset")
    return ordered.limit(size) if size <= TOP_ROWS else ordered


# ---------------------------------------------------------------- time slices


@dataclass(frozen=True)
class SlicePage:
    """Rows of a page of a time slice, the slice's id and its number of rows."""

    rows: DataFrame
    result_id: str
    total: int


def write_chunks(
    rows: DataFrame, path: str, total: int, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Write rows by their ``position`` (0-based) in chunks of fixed size; return the index.

    A chunk follows from the position alone, so rows are written where they are, unshuffled.
    """
    spark = rows.sparkSession
    chunk = F.expr(f"position div {rows_per_chunk}")
    rows.withColumn("chunk_id", chunk).write.partitionBy("chunk_id").parquet(path)
    start = F.col("id") * rows_per_chunk
    index = spark.range(ceil(total / rows_per_chunk)).select(
        F.concat(F.lit("chunk_id="), F.col("id")).alias("partName"),
        F.col("id").alias("chunk_id"),
        start.alias("startOffset"),
        (F.least(start + rows_per_chunk, F.lit(total)) - 1).alias("endOffset"),
    )
    index.coalesce(1).write.json(f"{path}_index")
    return spark.read.schema(CHUNK_INDEX).json(f"{path}_index")


def slice_extent(
    spark: SparkSession, path: str, start_timestamp: int, end_timestamp: int
) -> tuple[int, int]:
    """First offset (0-based) and number of rows of a closed time range of a result.

    The result is sorted, so the range is one run of offsets. Parts that lie inside it are
    known from the index; only those it cuts, and those with rows without a time, are read.
    """
    return _extent(spark, read_commit(spark, path), start_timestamp, end_timestamp)


def _extent(spark: SparkSession, commit: Commit, start: int, end: int) -> tuple[int, int]:
    check_range(start, end)
    index = _index(spark, commit)
    met = index.filter((F.col("endTimestamp") >= start) & (F.col("startTimestamp") <= end))
    inside = F.col("whole") & (F.col("startTimestamp") >= start) & (F.col("endTimestamp") <= end)
    known = met.filter(inside).agg(
        F.min("startOffset").alias("first"),
        F.sum(F.col("endOffset") - F.col("startOffset") + 1).alias("total"),
    )
    extents = [known.first()]
    cut = _with_offset(spark, commit, met.filter(~inside))
    if cut is not None:
        rows = in_time_slice(cut, start, end)
        extents.append(
            rows.agg(F.min("offset").alias("first"), F.count(F.lit(1)).alias("total")).first()
        )
    total = sum(x["total"] or 0 for x in extents)
    first = min((x["first"] for x in extents if x["first"] is not None), default=0)
    return first, total


def save_time_slice(
    spark: SparkSession, path: str, start_timestamp: int, end_timestamp: int
) -> tuple[str, int]:
    """The id and the size of the slice of a closed time range; an empty one has no id.

    The id tells the attempt, the first offset and the size, which is all there is to save.
    """
    commit = read_commit(spark, path)
    first, total = _extent(spark, commit, start_timestamp, end_timestamp)
    return (f"result_{commit.mark}_{first}_{total}" if total else ""), total


def export_time_slice(
    spark: SparkSession,
    path: str,
    start_timestamp: int,
    end_timestamp: int,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> tuple[str, int]:
    """Write the rows of a closed time range as chunks; return the export's id and size.

    An empty slice is not written and has an empty id.
    """
    check_positive("rows_per_chunk", rows_per_chunk)
    commit = read_commit(spark, path)
    first, total = _extent(spark, commit, start_timestamp, end_timestamp)
    if not total:
        return "", 0
    hit = _index(spark, commit).filter(
        (F.col("endOffset") >= first) & (F.col("startOffset") < first + total)
    )
    rows = _with_offset(spark, commit, hit)
    rows = rows.filter(F.col("offset").between(first, first + total - 1))
    export_id = f"export_{uuid.uuid4().hex}"
    positioned = rows.withColumn("position", F.col("offset") - first)
    write_chunks(
        positioned.drop("offset", *_STORED), f"{path}/slices/{export_id}", total, rows_per_chunk
    )
    return export_id, total


def read_chunk_index(spark: SparkSession, path: str, result_id: str) -> DataFrame:
    """Name, first and last position of each chunk of a saved slice."""
    saved = f"{path}/slices/{result_id}_index"
    if not result_id or not exists(spark, f"{saved}/_SUCCESS"):
        raise NotFoundError(f"no exported slice {result_id!r} at {path}")
    return spark.read.schema(CHUNK_INDEX).json(saved)


def read_chunks(
    spark: SparkSession, path: str, result_id: str, first: int, last: int
) -> DataFrame:
    """Rows of a run of chunks of a saved slice, with their 0-based ``position``."""
    stored = (
        StructType(list(read_commit(spark, path).schema.fields))
        .add("position", LongType())
        .add("chunk_id", LongType())
    )
    saved = f"{path}/slices/{result_id}"
    return (
        spark.read.schema(stored)
        .option("basePath", saved)
        .parquet(_directories(saved, "chunk_id", range(first, last + 1)))
        .filter(F.col("chunk_id").between(first, last))
    )


def slice_page(
    spark: SparkSession, path: str, result_id: str, start: int, end: int
) -> SlicePage:
    """Rows ``start`` to ``end`` of a saved slice, 1-based and inclusive, in order."""
    check_positive("start", start)
    check_range(start, end)
    return _slice_page(spark, read_commit(spark, path), result_id, start, end)


def _slice_page(
    spark: SparkSession, commit: Commit, result_id: str, start: int, end: int
) -> SlicePage:
    found = re.fullmatch(rf"result_{commit.mark}_(\d+)_(\d+)", result_id)
    if not found:
        raise NotFoundError(f"no saved slice {result_id!r} at {commit.base}")
    first, total = map(int, found.groups())
    last = min(end, total)
    if start > last:
        return SlicePage(_no_rows(spark, commit), result_id, total)
    page = _offset_page(spark, commit, first + start, first + last)
    rows = page.withColumn("offset", F.col("offset") - first)
    return SlicePage(rows, result_id, total)


def time_page(
    spark: SparkSession,
    path: str,
    start_timestamp: int,
    end_timestamp: int,
    start: int,
    end: int,
) -> SlicePage:
    """Rows ``start`` to ``end`` of the slice of a time range; nothing is written."""
    check_positive("start", start)
    check_range(start, end)
    commit = read_commit(spark, path)
    first, total = _extent(spark, commit, start_timestamp, end_timestamp)
    if not total:
        return SlicePage(_no_rows(spark, commit), "", 0)
    return _slice_page(spark, commit, f"result_{commit.mark}_{first}_{total}", start, end)
