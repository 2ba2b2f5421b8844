"""The log query: matching logs of a time range, sorted by time, and their histogram."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweir.functions.columns import epoch_seconds
from logweir.operators.filters import (
    ANY,
    by_keywords,
    by_level,
    by_origin,
    calendar_condition,
    check_positive,
    check_range,
    in_calendar_range,
    keyword_condition,
    keyword_pattern,
    level_condition,
    origin_conditions,
)
from logweir.operators.histogram import is_whole_minutes, time_histogram
from logweir.schemas import DEFAULT_PAYLOAD
from logweir.session import check_session
from logweir.sources.layouts import STANDARD_STRATEGY, PartitionStrategy
from logweir.sources.log_store import read_log_stores
from logweir.sources.result_store import (
    ROWS_PER_PART,
    SEQUENCE,
    check_absent,
    with_sequence,
    write_result,
    write_staged,
)
from logweir.sources.rollup import read_rollup
from logweir.sources.storage import staged, staged_by

# Searches that one scan answers; their conditions are one expression. More take more scans.
SEARCHES_PER_SCAN = 64
LOG_QUERY = "LogQuery"
HISTOGRAM = "Histogram"
QUERY_TYPES = (LOG_QUERY, HISTOGRAM)
SEARCH = "_search"


@dataclass(frozen=True)
class LogQuery:
    """What to look for. Times are epoch seconds; ``*`` switches a condition off."""

    start_time: int
    end_time: int
    level: str = ANY
    keywords: Sequence[str] | str = ()
    literal_keywords: bool = False
    app_name: str = ANY
    plugin: str = ANY
    doc_type: str = ANY

    def __post_init__(self) -> None:
        check_range(self.start_time, self.end_time)

    @property
    def is_selective(self) -> bool:
        """Whether it drops rows of the partitions it reads, and not only prunes them."""
        conditions = (self.level, self.app_name, keyword_pattern(self.keywords) or None)
        return any(value not in (None, ANY) for value in conditions)


@dataclass(frozen=True)
class SharedSearch:
    """A query, its histogram's window, and where the result of each query type goes."""

    query: LogQuery
    window: int | str
    paths: Mapping[str, str]


def matching_logs(store: DataFrame, query: LogQuery) -> DataFrame:
    """Payload of the matching rows, flattened, with ``timestamp`` in epoch seconds."""
    rows = in_calendar_range(store, query.start_time, query.end_time)
    rows = by_origin(rows, query.app_name, query.plugin, query.doc_type)
    rows = by_level(rows, query.level)
    rows = by_keywords(rows, query.keywords, literal=query.literal_keywords)
    return flatten(rows)


def match_condition(store: DataFrame, query: LogQuery) -> Column:
    """All conditions of a query as one, the cheap ones first."""
    terms = [
        calendar_condition(store, query.start_time, query.end_time),
        *origin_conditions(store, query.app_name, query.plugin, query.doc_type),
        level_condition(query.level),
        keyword_condition(store, query.keywords, literal=query.literal_keywords),
    ]
    return reduce(and_, [t for t in terms if t is not None])


def flatten(rows: DataFrame) -> DataFrame:
    return rows.select("data.*").withColumn("timestamp", epoch_seconds(F.col("time")))


def gathered(matches: DataFrame, query: LogQuery) -> DataFrame:
    """Bring the few matches of a selective query together before they are written.

    Each task of a large scan would write a file of a few rows otherwise. Adaptive execution
    merges small partitions and splits one that a busy second makes large. Without a
    selective condition files come out as large as the splits read, and nothing is moved.
    """
    return matches.hint("rebalance", "timestamp") if query.is_selective else matches


def log_query(
    store: DataFrame, query: LogQuery, tie_breakers: tuple[str, ...] = ()
) -> DataFrame:
    """Matching rows in time order, as a lazy plan.

    Rows that ``tie_breakers`` leave equal are ordered as scanned. That also lets the range
    partitioning split a second, or a repeated line, that holds a large share of the rows.
    """
    numbered = with_sequence(matching_logs(store, query))
    return numbered.orderBy("timestamp", *tie_breakers, SEQUENCE).drop(SEQUENCE)


def log_histogram(store: DataFrame, query: LogQuery, window: int | str) -> DataFrame:
    """Matches per time bucket, in time order, as a lazy plan."""
    return time_histogram(matching_logs(store, query), window).orderBy("timestamp")


def histogram_of_store(
    spark: SparkSession,
    root: str,
    query: LogQuery,
    window: int | str,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    payload: StructType = DEFAULT_PAYLOAD,
) -> DataFrame:
    """What :func:`log_histogram` gives for a whole log store, without a scan where possible.

    Without keywords and with buckets of whole minutes the counts landed with the batches
    answer it; else, or where a batch has none, the logs are scanned.
    """
    span = (query.start_time, query.end_time)
    counts = None
    if not keyword_pattern(query.keywords) and is_whole_minutes(window):
        counts = read_rollup(spark, root, span, strategy)
    if counts is None:
        logs = read_log_stores(spark, root, strategy, payload, span)
        return log_histogram(logs, query, window)
    found = counts.filter(match_condition(counts, query)).select("data.time", "count")
    return time_histogram(found, window, "count").orderBy("timestamp")


def run_log_query(
    store: DataFrame,
    query: LogQuery,
    path: str,
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> int:
    """Store result, statistics and part metadata of a log query; return the row count."""
    check_session(store.sparkSession)
    matches = gathered(matching_logs(store, query), query)
    return write_result(matches, path, tie_breakers, rows_per_part)


def run_histogram(
    store: DataFrame,
    query: LogQuery,
    window: int | str,
    path: str,
    rows_per_part: int = ROWS_PER_PART,
) -> int:
    """Store a histogram in the same form as a log query."""
    check_session(store.sparkSession)
    buckets = time_histogram(matching_logs(store, query), window)
    return write_result(buckets, path, rows_per_part=rows_per_part)


def run_all(
    store: DataFrame,
    query: LogQuery,
    window: int | str,
    paths: Mapping[str, str],
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> dict[str, int]:
    """Store every query type in ``paths``; return the row count of each.

    The types share their matches, so the store is scanned once for all of them.
    """
    spark = store.sparkSession
    check_session(spark)
    check_positive("rows_per_part", rows_per_part)
    for path in paths.values():
        check_absent(spark, path)
    if LOG_QUERY not in paths:
        return {
            t: run_histogram(store, query, window, path, rows_per_part)
            for t, path in paths.items()
        }
    counts = {}
    found = gathered(matching_logs(store, query), query)
    with staged(with_sequence(found), "matches") as matches:
        counts[LOG_QUERY] = write_staged(
            matches, paths[LOG_QUERY], tie_breakers, rows_per_part
        )
        if HISTOGRAM in paths:
            counts[HISTOGRAM] = write_result(
                time_histogram(matches, window), paths[HISTOGRAM], rows_per_part=rows_per_part
            )
    return counts


def matches_of_searches(store: DataFrame, queries: Sequence[LogQuery]) -> DataFrame:
    """Matches of several queries in one scan, as :func:`matching_logs` of each would give them.

    ``_search`` is the place of the query in the list; a row that several of them match comes
    once for each. The days from the first to the last of all ranges prune the scan, and so
    does each query's own range.
    """
    conditions = [match_condition(store, q) for q in queries]
    start = min(q.start_time for q in queries)
    end = max(q.end_time for q in queries)
    rows = in_calendar_range(store, start, end).filter(reduce(or_, conditions))
    hits = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]))
    rows = rows.select("data.*", F.explode(hits).alias(SEARCH))
    return rows.withColumn("timestamp", epoch_seconds(F.col("time")))


def run_searches(
    store: DataFrame,
    searches: Mapping[str, SharedSearch],
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> dict[str, dict[str, int]]:
    """Store the results of several searches over one scan; return the row counts of each.

    The matches are staged once, in a folder per search, so that each result reads only its
    own rows. Every result is committed by itself: after a failure, the searches without a
    commit are to be run again. Results that exist already are refused before the scan.
    """
    spark = store.sparkSession
    check_session(spark)
    check_positive("rows_per_part", rows_per_part)
    for search in searches.values():
        for path in search.paths.values():
            check_absent(spark, path)
    counts = {}
    names = list(searches)
    for at in range(0, len(names), SEARCHES_PER_SCAN):
        some = names[at : at + SEARCHES_PER_SCAN]
        found = matches_of_searches(store, [searches[n].query for n in some])
        # One search's rows lie in few files; adaptive execution splits those of a large one.
        found = with_sequence(found.hint("rebalance", SEARCH))
        with staged_by(found, SEARCH, "searches") as matches_of:
            for place, name in enumerate(some):
                counts[name] = _write_search(
                    matches_of(place), searches[name], tie_breakers, rows_per_part
                )
    return counts


def _write_search(
    matches: DataFrame, search: SharedSearch, tie_breakers: tuple[str, ...], rows_per_part: int
) -> dict[str, int]:
    counts = {}
    if LOG_QUERY in search.paths:
        path = search.paths[LOG_QUERY]
        counts[LOG_QUERY] = write_staged(matches, path, tie_breakers, rows_per_part)
    if HISTOGRAM in search.paths:
        buckets = time_histogram(matches, search.window)
        path = search.paths[HISTOGRAM]
        counts[HISTOGRAM] = write_result(buckets, path, rows_per_part=rows_per_part)
    return counts
