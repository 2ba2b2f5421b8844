"""Past jobs with the row counts of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logweir.operators.catalog import list_jobs, with_stored_statistics
from logweir.operators.filters import ANY
from logweir.plans.log_query import HISTOGRAM, LOG_QUERY
from logweir.sources.result_store import read_job_statistics

_PREFIX = {LOG_QUERY: "logQuery", HISTOGRAM: "histogram"}


def job_listing(
    jobs: DataFrame, root: str, app_name: str = ANY, search: str = ANY
) -> DataFrame:
    """Jobs newest first, completed ones with the counts stored under ``root``, by query type."""
    for query_type, prefix in _PREFIX.items():
        stored = read_job_statistics(jobs.sparkSession, root, query_type)
        jobs = with_stored_statistics(jobs, stored, prefix)
    return list_jobs(jobs, app_name, search)
