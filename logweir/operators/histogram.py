"""Counts per time bucket."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.errors import ValidationError

# Counts of units of fixed length; months and years are none.
_DURATION = re.compile(
    r"([1-9]\d*\s*(millisecond|second|minute|hour|day|week)s?\s*)+"
)


def duration(window: int | str) -> str:
    """Bucket width as Spark takes it: a number of seconds, or text such as ``1 hour``."""
    if isinstance(window, str) and not window.strip().isdigit():
        if not _DURATION.fullmatch(window.strip().lower()):
            raise ValidationError(f"not a histogram window of fixed length: {window!r}")
        return window
    seconds = int(window)
    if seconds <= 0:
        raise ValidationError(f"histogram window must be positive: {window!r}")
    return f"{seconds} seconds"


def is_whole_minutes(window: int | str) -> bool:
    """Whether buckets of this width begin and end at full minutes."""
    total = timedelta()
    for number, unit in re.findall(r"(\d+)\s*([a-z]+?)s?(?![a-z])", duration(window).lower()):
        total += timedelta(**{f"{unit}s": int(number)})
    return total % timedelta(minutes=1) == timedelta()


def time_histogram(
    matches: DataFrame, window: int | str, weight: str | None = None
) -> DataFrame:
    """Matches per bucket: ``start``, ``end``, ``count`` and ``timestamp`` (start in seconds).

    Buckets are aligned to the epoch and empty ones are left out. Counts are combined
    before the shuffle, so a crowded bucket costs no more than a quiet one. A row counts as
    often as its ``weight`` says, once without.
    """
    often = F.count(F.lit(1)) if weight is None else F.sum(weight)
    bucket = F.window("time", duration(window))
    return (
        matches.groupBy(bucket.alias("bucket"))
        .agg(often.alias("count"))
        .select(
            F.col("bucket.start").alias("start"),
            F.col("bucket.end").alias("end"),
            "count",
            F.col("bucket.start").cast("long").alias("timestamp"),
        )
    )
