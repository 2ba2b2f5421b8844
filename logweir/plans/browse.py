"""Read a stored result by offset, by time, from a saved slice, or whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logweir.errors import ValidationError
from logweir.functions.columns import render_times
from logweir.operators.filters import check_positive, check_range
from logweir.plans.saved_search import result_path
from logweir.sources.result_store import (
    offset_page,
    read_result,
    read_statistics,
    slice_page,
    time_page,
)

MODES = ("offset", "time", "result")


@dataclass(frozen=True)
class BrowsePage:
    """Rows of a page, the size of what is paged, and the slice's id if there is one."""

    rows: DataFrame
    total: int
    result_id: str = ""


def browse(
    spark: SparkSession,
    root: str,
    job_id: str,
    query_type: str,
    mode: str | None = None,
    start: int | None = None,
    end: int | None = None,
    start_timestamp: int | None = None,
    end_timestamp: int | None = None,
    result_id: str | None = None,
) -> BrowsePage:
    """A page of a job's result; times are rendered as text.

    ``start`` and ``end`` are 1-based and inclusive. Mode ``offset`` pages the result,
    ``time`` finds the slice of a time range and pages it, ``result`` pages a slice by its id,
    and no mode gives the whole result: each row with its offset, file by file, since sorting
    what is stored in order would shuffle all of it again.
    """
    path = result_path(root, job_id, query_type)
    if mode is not None and mode not in MODES:
        raise ValidationError(f"invalid mode: {mode!r}")
    if mode is None:
        return BrowsePage(
            render_times(read_result(spark, path)), _total(spark, path)
        )
    if start is None or end is None:
        raise ValidationError("a page needs a start and an end")
    check_positive("start", start)
    check_range(start, end)
    if mode == "offset":
        return BrowsePage(
            render_times(offset_page(spark, path, start, end)), _total(spark, path)
        )
    if mode == "time":
        if start_timestamp is None or end_timestamp is None:
            raise ValidationError("mode 'time' needs a start and an end timestamp")
        page = time_page(spark, path, start_timestamp, end_timestamp, start, end)
    else:
        page = slice_page(spark, path, result_id or "", start, end)
    return BrowsePage(render_times(page.rows), page.total, page.result_id)


def _total(spark: SparkSession, path: str) -> int:
    return read_statistics(spark, path).first()["value"]
