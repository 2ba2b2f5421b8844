"""Log analytics on Spark: ingest mixed JSON logs, query them, browse the results."""

from logweir.errors import ConfigurationError, LogweirError, NotFoundError, ValidationError
from logweir.operators.catalog import (
    decode_jobs,
    decode_signatures,
    list_jobs,
    search_signatures,
    signature_page,
)
from logweir.plans.browse import BrowsePage, browse
from logweir.plans.log_query import (
    LogQuery,
    log_histogram,
    log_query,
    run_histogram,
    run_log_query,
)
from logweir.plans.saved_search import JobRequest, run_signature
from logweir.session import prepare
from logweir.sources.kafka import read_topic
from logweir.sources.log_store import (
    compact_days,
    read_compacted,
    read_log_store,
    read_log_stores,
    read_logs,
)
from logweir.streaming.ingest import land_batch, start_ingest

__all__ = [
    "BrowsePage",
    "ConfigurationError",
    "JobRequest",
    "LogQuery",
    "LogweirError",
    "NotFoundError",
    "ValidationError",
    "browse",
    "compact_days",
    "decode_jobs",
    "decode_signatures",
    "land_batch",
    "list_jobs",
    "log_histogram",
    "log_query",
    "prepare",
    "read_compacted",
    "read_log_store",
    "read_log_stores",
    "read_logs",
    "read_topic",
    "run_histogram",
    "run_log_query",
    "run_signature",
    "search_signatures",
    "signature_page",
    "start_ingest",
]
