from datetime import UTC, date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import epoch, log_rows, values
from logweir.errors import ValidationError
from logweir.functions.patterns import checked_pattern
from logweir.operators import filters
from logweir.plans.log_query import LogQuery, log_query
from logweir.sources.log_store import span_pattern

FIRST_DAY = date(2016, 1, 1)
N_DAYS = (date(2021, 1, 1) - FIRST_DAY).days


@pytest.fixture(scope="module")
def grid(spark):
    """One row per day of five years, two of them leap years."""
    days = spark.range(N_DAYS).select(
        F.date_add(F.lit(FIRST_DAY), F.col("id").cast("int")).alias("date")
    )
    days = days.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.timestamp_seconds(F.unix_timestamp("date") + 43_200).alias("_time"),
    )
    return days.cache()


def _expected(start, end):
    first, last = (datetime.fromtimestamp(t, UTC).date() for t in (start, end))
    first, last = max(first, FIRST_DAY), min(last, FIRST_DAY + timedelta(N_DAYS - 1))
    return [first + timedelta(n) for n in range((last - first).days + 1)]


SPANS = {
    "one day": (epoch(2018, 5, 5), epoch(2018, 5, 5, 23)),
    "start is end": (epoch(2018, 5, 5, 7), epoch(2018, 5, 5, 7)),
    "one month": (epoch(2018, 5, 1), epoch(2018, 5, 31)),
    "adjacent months": (epoch(2018, 1, 20), epoch(2018, 2, 3)),
    "months with a gap": (epoch(2018, 1, 20), epoch(2018, 6, 3)),
    "year change": (epoch(2017, 12, 20), epoch(2018, 1, 10)),
    "different years": (epoch(2017, 10, 20), epoch(2018, 3, 10)),
    "several years": (epoch(2017, 3, 20), epoch(2020, 2, 10)),
    "leap day": (epoch(2020, 2, 28), epoch(2020, 3, 1)),
}


@pytest.mark.parametrize("span", SPANS.values(), ids=SPANS)
@pytest.mark.parametrize("drop", [(), ("_time",), ("year", "month", "day")], ids=str)
def test_calendar_range(grid, span, drop):
    found = filters.in_calendar_range(grid.drop(*drop), *span)
    assert sorted(values(found, "date")) == _expected(*span)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.integers(epoch(2015, 12, 1), epoch(2021, 2, 1)),
    st.integers(0, 900 * 86_400),
)
def test_calendar_range_is_between_dates(grid, start, length):
    found = filters.in_calendar_range(grid, start, start + length)
    assert sorted(values(found, "date")) == _expected(start, start + length)


def test_range_must_not_end_before_it_starts(grid):
    with pytest.raises(ValidationError):
        filters.in_calendar_range(grid, 10, 9)
    with pytest.raises(ValidationError):
        LogQuery(10, 9)
    with pytest.raises(ValidationError, match="epoch seconds"):
        filters.in_calendar_range(grid, 0, 1704844800000)
    with pytest.raises(ValidationError):
        filters.in_time_slice(grid, 10, 9)


def test_calendar_range_needs_something_to_filter_on(grid):
    with pytest.raises(ValidationError):
        filters.in_calendar_range(grid.select("date"), 0, 1)


@settings(max_examples=60, deadline=None)
@given(
    st.integers(epoch(1999, 1, 1), epoch(2030, 1, 1)),
    st.integers(0, 9000 * 86_400),
    st.permutations(["_documentType", "_plugin"]),
    st.integers(0, 3),
)
def test_span_pattern_covers_every_day(start, length, head, depth):
    layout = (*head, *filters.CALENDAR[:depth])
    pattern = span_pattern(layout, start, start + length)
    if not pattern:
        assert depth == 0 or length > 60 * 365 * 86_400
        return
    alternatives = pattern[1:-1].split(",")
    assert len(alternatives) <= 64
    named = {tuple(level.split("=") for level in a.split("/")) and a for a in alternatives}
    first, last = filters.days_of(start, start + length)
    for n in range((last - first).days + 1):
        day = first + timedelta(n)
        assert any(
            all(
                value == "*" or int(value) == getattr(day, name)
                for name, value in (level.split("=") for level in alternative.split("/"))
            )
            for alternative in named
        )


def test_level(spark):
    rows = log_rows(
        spark, [(None, "error", "a"), (None, "ERROR", "b"), (None, None, "c"), (None, "*", "d")]
    )
    found = filters.by_level(rows, "ERROR")
    assert values(found, "data.message") == ["a"]
    assert filters.by_level(rows, "*") is rows
    assert filters.by_level(rows, None) is rows


@pytest.mark.parametrize(
    ("keywords", "literal", "expected"),
    [
        ((), False, ["disk full", "Disk ok", "a.b", "a+b", None]),
        ("", False, ["disk full", "Disk ok", "a.b", "a+b", None]),
        (["isk"], False, ["disk full", "Disk ok"]),
        (["disk"], False, ["disk full"]),
        (["full", "ok$"], False, ["disk full", "Disk ok"]),
        ("full|ok", False, ["disk full", "Disk ok"]),
        (["a.b"], False, ["a.b", "a+b"]),
        (["a.b"], True, ["a.b"]),
        (["+"], True, ["a+b"]),
        ("+|full", True, ["disk full", "a+b"]),
    ],
)
def test_keywords(spark, keywords, literal, expected):
    messages = ["disk full", "Disk ok", "a.b", "a+b", None]
    rows = log_rows(spark, [(None, "info", m) for m in messages])
    found = values(filters.by_keywords(rows, keywords, literal=literal), "data.message")
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_bad_pattern_fails_before_a_job(spark):
    rows = log_rows(spark, [(None, "info", "x")])
    with pytest.raises(ValidationError, match="regular expression"):
        filters.by_keywords(rows, ["("])
    assert checked_pattern(spark, "it's (fine)") == "it's (fine)"


def test_origin_filters_are_off_unless_asked_for(spark):
    rows = log_rows(spark, [(None, "info", "x")])
    assert filters.by_origin(rows) is rows
    assert filters.by_origin(rows, plugin="p", doc_type="t").count() == 1
    assert filters.by_origin(rows, plugin="q").count() == 0
    assert filters.by_origin(rows, app_name="app").count() == 0


def test_log_query_sorts_and_keeps_equal_rows(spark):
    rows = [
        ("2024-01-02 00:00:05", "error", "disk 3"),
        ("2024-01-01 10:00:00", "error", "disk 1"),
        ("2024-01-02 00:00:05", "error", "disk 3"),
        ("2024-01-01 23:59:59.999", "error", "disk 2"),
        ("2024-01-03 00:00:00", "error", "disk late"),
        (None, "error", "disk never"),
        ("2024-01-02 12:00:00", "info", "disk calm"),
    ]
    query = LogQuery(epoch(2024, 1, 1, 12), epoch(2024, 1, 2, 0), "ERROR", ["disk"])
    for ties in ((), ("message",)):
        found = log_query(log_rows(spark, rows), query, ties)
        assert found.columns[-1] == "timestamp"
        # Whole days count: 10:00 of the first day and 00:00:05 of the last are in.
        assert values(found, "message", "timestamp") == [
            ("disk 1", epoch(2024, 1, 1, 10)),
            ("disk 2", epoch(2024, 1, 1, 23, 59, 59)),
            ("disk 3", epoch(2024, 1, 2, 0, 0, 5)),
            ("disk 3", epoch(2024, 1, 2, 0, 0, 5)),
        ]
