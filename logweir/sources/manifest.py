"""Which batches have landed, and which of them each compacted day holds.

A batch of several datasets is there once its commit is: a small file below ``commits`` of the
store, written after all of them. It has a line for every dataset and every run of days that
its rows fall on::

    commits/<stream>/<batch>.json    stream_id, batch_id, layout, first, last, rows

Compacting days adds an entry to the manifest of the compacted dataset: the days, the folder
their rows are in, and for each stream the last batch taken in. The latest entry of a day
counts::

    manifest/<number>.json           number, generation, first, last, through
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.errors import NotFoundError
from logweir.operators.filters import days_of
from logweir.sources.storage import exists, read_text, write_new

COMMIT = "stream_id string, batch_id long, layout string, first date, last date, rows long"
ENTRY = "number long, generation string, first date, last date, through map<string, long>"

# Batches are named by ranges of their numbers up to so many; beyond, they are joined.
LISTED_RANGES = 256

Span = tuple[int, int]


def _commit_path(root: str, stream_id: str, batch_id: int) -> str:
    return f"{root}/commits/{stream_id}/{batch_id}.json"


def runs_of(days: Iterable[date]) -> list[tuple[date, date]]:
    """Longest runs of days that follow each other."""
    found: list[tuple[date, date]] = []
    for day in sorted(set(days)):
        if found and day - found[-1][1] == timedelta(1):
            found[-1] = (found[-1][0], day)
        else:
            found.append((day, day))
    return found


def commit_batch(
    spark: SparkSession,
    root: str,
    stream_id: str,
    batch_id: int,
    rows: dict[str, dict[date | None, int]],
) -> None:
    """Make a batch visible, with its rows by dataset and day."""
    lines = []
    for layout, by_day in rows.items():
        dated = [d for d in by_day if d is not None]
        spans = [(str(a), str(b)) for a, b in runs_of(dated)] or [(None, None)]
        if dated and None in by_day:
            spans.append((None, None))
        for k, (first, last) in enumerate(spans):
            lines.append(
                {
                    "stream_id": stream_id,
                    "batch_id": batch_id,
                    "layout": layout,
                    "first": first,
                    "last": last,
                    "rows": 0 if k else sum(by_day.values()),
                }
            )
    # A batch without rows has landed too.
    lines = lines or [{"stream_id": stream_id, "batch_id": batch_id}]
    text = "\n".join(map(json.dumps, lines)) + "\n"
    write_new(spark, _commit_path(root, stream_id, batch_id), text)


def committed_rows(
    spark: SparkSession, root: str, stream_id: str, batch_id: int
) -> dict[str, int] | None:
    """Rows by dataset of a batch that has landed, ``None`` for one that has not."""
    path = _commit_path(root, stream_id, batch_id)
    if not exists(spark, path):
        return None
    counts: dict[str, int] = {}
    for line in map(json.loads, read_text(spark, path).splitlines()):
        if "layout" in line:
            counts[line["layout"]] = counts.get(line["layout"], 0) + line["rows"]
    return counts


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/commits"
    if not exists(spark, path):
        raise NotFoundError(f"no logs under {root}")
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(path)


def closed_batches(commits: DataFrame) -> dict[str, int]:
    """Per stream the last batch before the first that is missing: nothing lands there later."""
    batches = commits.select("stream_id", "batch_id").distinct()
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("batch_id"))
    island = F.col("batch_id") - place
    first = F.min("island").over(Window.partitionBy("stream_id"))
    reached = (
        batches.withColumn("island", island)
        .withColumn("first", first)
        .filter("island = first")
        .groupBy("stream_id")
        .agg(F.max("batch_id").alias("batch_id"))
    )
    return {r["stream_id"]: r["batch_id"] for r in reached.collect()}


def live_batches(
    commits: DataFrame,
    layouts: list[str],
    span: Span | None = None,
    taken: DataFrame | None = None,
    through: dict[str, int] | None = None,
) -> DataFrame:
    """Landed batches with rows of these datasets that no compacted day holds.

    ``partly`` tells that some of a batch's days are compacted with it and others are not.
    With ``span``, days outside it do not count; ``through`` leaves out later batches.
    """
    rows = commits.filter(F.col("layout").isin(layouts))
    if through is not None:
        last = F.lit(None).cast("long")
        for stream_id, batch_id in through.items():
            last = F.when(F.col("stream_id") == stream_id, F.lit(batch_id)).otherwise(last)
        rows = rows.filter(F.col("batch_id") <= last)
    first, last = F.col("first"), F.col("last")
    if span:
        low, high = map(F.lit, days_of(*span))
        rows = rows.filter((first <= high) & (last >= low))
        first, last = F.greatest(first, low), F.least(last, high)
    if taken is None:
        return rows.select("stream_id", "batch_id").distinct().withColumn("partly", F.lit(False))
    day = F.explode_outer(F.sequence(first, last)).alias("day_")
    held = F.coalesce(F.col("batch_id") <= F.col("through"), F.lit(False))
    return (
        rows.select("stream_id", "batch_id", day)
        .join(taken, ["stream_id", "day_"], "left")
        .groupBy("stream_id", "batch_id")
        .agg(F.bool_or(held).alias("partly"), F.bool_and(held).alias("held"))
        .filter("not held")
        .drop("held")
    )


def only_batches(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows of the batches listed, as a partition filter where these are few ranges."""
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("batch_id"))
    ranges = (
        batches.select("stream_id", "batch_id", (F.col("batch_id") - place).alias("island"))
        .groupBy("stream_id", "island")
        .agg(F.min("batch_id").alias("low"), F.max("batch_id").alias("high"))
        .limit(LISTED_RANGES + 1)
        .collect()
    )
    if len(ranges) > LISTED_RANGES:
        return rows.join(batches.select("stream_id", "batch_id"), ["stream_id", "batch_id"], "left_semi")
    named = [
        (F.col("stream_id") == r["stream_id"]) & F.col("batch_id").between(r["low"], r["high"])
        for r in ranges
    ]
    return rows.filter(reduce(Column.__or__, named, F.lit(False)))


@dataclass(frozen=True)
class Closed:
    """Days whose rows lie in one folder of a compacted dataset."""

    generation: str
    first: date
    last: date
    through: dict[str, int]
    whole: bool


def add_entry(
    spark: SparkSession,
    target: str,
    generation: str,
    first: date,
    last: date,
    through: dict[str, int],
) -> None:
    """Let a folder of compacted days count, from the next read on."""
    path = f"{target}/manifest"
    number = 0
    if exists(spark, path):
        number = spark.read.schema(ENTRY).json(path).agg({"number": "max"}).first()[0] + 1
    line = {
        "number": number,
        "generation": generation,
        "first": str(first),
        "last": str(last),
        "through": through,
    }
    while not write_new(spark, f"{path}/{line['number']:09d}.json", json.dumps(line) + "\n"):
        line["number"] += 1


def closed_days(spark: SparkSession, target: str, span: Span | None = None) -> list[Closed]:
    """Runs of compacted days, each with the latest entry that covers it.

    There is an entry per compaction, so they are few beside the rows.
    """
    path = f"{target}/manifest"
    if not exists(spark, path):
        return []
    entries = spark.read.schema(ENTRY).json(path).orderBy("number").collect()
    owner: dict[date, int] = {}
    covered = [0] * len(entries)
    for k, entry in enumerate(entries):
        covered[k] = (entry["last"] - entry["first"]).days + 1
        owner |= {entry["first"] + timedelta(n): k for n in range(covered[k])}
    held: dict[int, list[date]] = {}
    for day, k in owner.items():
        held.setdefault(k, []).append(day)
    low, high = days_of(*span) if span else (date.min, date.max)
    return [
        Closed(
            entries[k]["generation"],
            max(a, low),
            min(b, high),
            dict(entries[k]["through"] or {}),
            len(days) == covered[k],
        )
        for k, days in sorted(held.items())
        for a, b in runs_of(days)
        if a <= high and b >= low
    ]


def taken_days(spark: SparkSession, closed: list[Closed]) -> DataFrame | None:
    """``stream_id``, ``day_`` and the last batch of the stream that the day has taken in."""
    rows = [(s, c.first, c.last, n) for c in closed for s, n in c.through.items()]
    if not rows:
        return None
    spans = spark.createDataFrame(rows, "stream_id string, first date, last date, through long")
    return spans.select("stream_id", F.explode(F.sequence("first", "last")).alias("day_"), "through")


def in_generations(closed: list[Closed]) -> Column:
    """Rows of compacted days in the folder that counts for their day."""
    whole = sorted({c.generation for c in closed if c.whole})
    named = F.col("generation").isin(whole) if whole else F.lit(False)
    day = F.make_date("year", "month", "day")
    parts = [
        (F.col("generation") == c.generation) & day.between(F.lit(c.first), F.lit(c.last))
        for c in closed
        if not c.whole
    ]
    return reduce(Column.__or__, parts, named)
