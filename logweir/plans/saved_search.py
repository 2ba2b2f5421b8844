"""Run a saved search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from logweir.errors import NotFoundError, ValidationError
from logweir.operators.catalog import signature_by_id
from logweir.operators.filters import ANY
from logweir.plans.log_query import QUERY_TYPES, LogQuery, SharedSearch, run_all, run_searches
from logweir.sources.result_store import ROWS_PER_PART


@dataclass(frozen=True)
class JobRequest:
    """A saved search, the range to run it over (epoch seconds) and the histogram's window.

    With ``literal_keywords`` its keywords are plain substrings, not regular expressions.
    """

    signature_id: str
    start_time: int
    end_time: int
    histogram_window: int | str = "1 hour"
    literal_keywords: bool = False


def query_of(signatures: DataFrame, request: JobRequest, apply_origin: bool = False) -> LogQuery:
    """The log query of a saved search.

    Its plugin and document type take effect only with ``apply_origin``.
    """
    return _query(signature_by_id(signatures, request.signature_id).first(), request, apply_origin)


def _query(saved: Row, request: JobRequest, apply_origin: bool) -> LogQuery:
    return LogQuery(
        request.start_time,
        request.end_time,
        saved["logLevel"],
        saved["keywords"] or (),
        request.literal_keywords,
        plugin=saved["plugin"] if apply_origin else ANY,
        doc_type=saved["docType"] if apply_origin else ANY,
    )


def result_path(root: str, job_id: str, query_type: str) -> str:
    if query_type not in QUERY_TYPES:
        raise ValidationError(f"invalid query type: {query_type!r}")
    return f"{root}/{job_id}_{query_type}"


def run_signature(
    store: DataFrame,
    signatures: DataFrame,
    request: JobRequest,
    root: str,
    job_id: str,
    query_types: Sequence[str] = QUERY_TYPES,
    apply_origin: bool = False,
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> dict[str, int]:
    """Run every query type of a saved search into ``<root>/<job>_<type>``."""
    paths = {t: result_path(root, job_id, t) for t in query_types}
    query = query_of(signatures, request, apply_origin)
    return run_all(store, query, request.histogram_window, paths, tie_breakers, rows_per_part)


def run_signatures(
    store: DataFrame,
    signatures: DataFrame,
    requests: Mapping[str, JobRequest],
    root: str,
    query_types: Sequence[str] = QUERY_TYPES,
    apply_origin: bool = False,
    tie_breakers: tuple[str, ...] = (),
    rows_per_part: int = ROWS_PER_PART,
) -> dict[str, dict[str, int]]:
    """Run pending jobs, by job id, over one scan of the store.

    Each job stores what :func:`run_signature` would. Nothing is run where a signature is
    unknown, a result exists, or a keyword is no pattern.
    """
    wanted = {r.signature_id for r in requests.values()}
    known = signatures.where(F.col("signatureId").isin(*wanted)).collect() if wanted else []
    saved = {row["signatureId"]: row for row in known}
    unknown = sorted(wanted - set(saved))
    if unknown:
        raise NotFoundError(f"no such signatures: {', '.join(unknown)}")
    searches = {
        job: SharedSearch(
            _query(saved[r.signature_id], r, apply_origin),
            r.histogram_window,
            {t: result_path(root, job, t) for t in query_types},
        )
        for job, r in requests.items()
    }
    return run_searches(store, searches, tie_breakers, rows_per_part)
