"""Small column helpers shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

RENDERED = ("time", "start", "end")


def epoch_seconds(time: Column) -> Column:
    """Whole epoch seconds of a timestamp, with or without time zone."""
    return time.cast("timestamp").cast("long")


def rendered(time: Column) -> Column:
    """Timestamp text to the second, with six decimals only where there is a fraction."""
    fraction = F.date_format(time, "SSSSSS")
    return F.when(fraction == "000000", F.date_format(time, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def render_times(df: DataFrame) -> DataFrame:
    """Show ``time``, ``start`` and ``end`` as text where the frame has them."""
    shown = {}
    for name in RENDERED:
        if name in df.columns:
            is_time = isinstance(df.schema[name].dataType, (TimestampType, TimestampNTZType))
            shown[name] = rendered(F.col(name)) if is_time else F.col(name).cast("string")
    return df.withColumns(shown) if shown else df


def base_name(path: Column) -> Column:
    """Last component of a slash-separated path."""
    return F.substring_index(path, "/", -1)


def progress_status(percentage: Column) -> Column:
    """Status word of a progress percentage."""
    # The status words and the two reserved percentages.
    return (
        F.when(percentage == 100, "COMPLETED")
        .when(percentage.between(1, 99), "RUNNING")
        .when(percentage == 0, "NOT STARTED")
        .when(percentage == 999, "FAILED")
        .otherwise("UNKNOWN")
    )
