"""Predicates of a log query.

Every function takes and returns a DataFrame of the log store (or of a result) and only
adds deterministic column predicates, so Catalyst can push them into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, date, datetime, time, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from logweir.errors import ValidationError
from logweir.functions.patterns import checked_pattern

ANY = "*"
CALENDAR = ("year", "month", "day")


def check_range(start: int, end: int) -> None:
    if start > end:
        raise ValidationError(f"range starts after it ends: {start} > {end}")


def check_positive(name: str, number: int) -> None:
    if number < 1:
        raise ValidationError(f"{name} must be at least 1: {number}")


def days_of(start_time: int, end_time: int) -> tuple[date, date]:
    """UTC days of the first and last epoch second of a range."""
    check_range(start_time, end_time)
    try:
        first, last = (datetime.fromtimestamp(t, UTC).date() for t in (start_time, end_time))
    except (OverflowError, OSError, ValueError) as error:
        raise ValidationError("times are epoch seconds of a calendar year") from error
    return first, last


def _midnight(day: date) -> Column:
    return F.lit(datetime.combine(day, time(), UTC))


def _event_time(df: DataFrame) -> str | None:
    """The column with the event time: the payload's, which a query reads anyway."""
    payload = df.schema["data"].dataType if "data" in df.columns else None
    if isinstance(payload, StructType) and "time" in payload.fieldNames():
        if isinstance(payload["time"].dataType, TimestampType):
            return "data.time"
    return "_time" if "_time" in df.columns else None


def in_calendar_range(df: DataFrame, start_time: int, end_time: int) -> DataFrame:
    """Rows of the days touched by ``[start_time, end_time]`` (epoch seconds)."""
    return df.filter(calendar_condition(df, start_time, end_time))


def calendar_condition(df: DataFrame, start_time: int, end_time: int) -> Column:
    """Whether a row is of the days touched by ``[start_time, end_time]`` (epoch seconds).

    The cut is by whole days. The same range is stated at each depth at which a layout may
    be partitioned (year; year and month; day), so that each layout prunes directories as
    far as its depth goes, and on the event time, whose file statistics skip stripes in
    layouts that are not partitioned by date.
    """
    first, last = days_of(start_time, end_time)
    terms = []
    event_time = _event_time(df)
    if event_time is not None:
        terms += [
            F.col(event_time) >= _midnight(first),
            F.col(event_time) < _midnight(last + timedelta(days=1)),
        ]
    if set(CALENDAR) <= set(df.columns):
        year, month, day = (F.col(c) for c in CALENDAR)
        terms += [
            year.between(first.year, last.year),
            (year * 12 + month).between(
                first.year * 12 + first.month, last.year * 12 + last.month
            ),
            F.make_date(year, month, day).between(F.lit(first), F.lit(last)),
        ]
    if not terms:
        raise ValidationError("no calendar columns and no event time to filter on")
    return reduce(and_, terms)


def by_level(df: DataFrame, level: str | None, column: str = "data.level") -> DataFrame:
    """Rows of one level. The argument is lower-cased, the stored value is not."""
    condition = level_condition(level, column)
    return df if condition is None else df.filter(condition)


def level_condition(level: str | None, column: str = "data.level") -> Column | None:
    """Whether a row is of a level; ``None`` for any level."""
    if level is None or level == ANY:
        return None
    return F.col(column) == F.lit(level.lower())


def keyword_pattern(keywords: Sequence[str] | str | None) -> str:
    """One alternation of all keywords; empty when there are none."""
    if not keywords:
        return ""
    return keywords if isinstance(keywords, str) else "|".join(keywords)


def by_keywords(
    df: DataFrame,
    keywords: Sequence[str] | str | None,
    column: str = "data.message",
    literal: bool = False,
) -> DataFrame:
    """Rows whose message matches any keyword; a null message never does.

    Keywords are unanchored, case-sensitive regular expressions, or plain substrings when
    ``literal`` is set. A string holds several keywords separated by bars.
    """
    condition = keyword_condition(df, keywords, column, literal)
    return df if condition is None else df.filter(condition)


def keyword_condition(
    df: DataFrame,
    keywords: Sequence[str] | str | None,
    column: str = "data.message",
    literal: bool = False,
) -> Column | None:
    """Whether a message matches any keyword; ``None`` without keywords."""
    pattern = keyword_pattern(keywords)
    if not pattern:
        return None
    if not literal:
        return F.col(column).rlike(checked_pattern(df.sparkSession, pattern))
    words = keywords.split("|") if isinstance(keywords, str) else list(keywords)
    return reduce(or_, [F.contains(F.col(column), F.lit(w)) for w in words])


def by_origin(
    df: DataFrame,
    app_name: str | None = ANY,
    plugin: str | None = ANY,
    doc_type: str | None = ANY,
) -> DataFrame:
    """Optional equality on application, plugin and document type."""
    for condition in origin_conditions(df, app_name, plugin, doc_type):
        df = df.filter(condition)
    return df


def origin_conditions(
    df: DataFrame,
    app_name: str | None = ANY,
    plugin: str | None = ANY,
    doc_type: str | None = ANY,
) -> list[Column]:
    """A condition for each of application, plugin and document type that is asked for."""
    conditions = []
    wanted = {"_tag_appName": app_name, "_plugin": plugin, "_documentType": doc_type}
    for name, value in wanted.items():
        if value is not None and value != ANY:
            # The top-level copy is a partition column, so it prunes directories.
            column = name if name in df.columns else f"data.{name}"
            conditions.append(F.col(column) == F.lit(value))
    return conditions


def in_time_slice(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of a result with ``start <= timestamp <= end``."""
    check_range(start, end)
    return df.filter(F.col("timestamp").between(start, end))
