"""The jobs as ``spark-submit submit.py <job> <arguments>`` runs them.

ingest      CHECKPOINT OUTPUT BROKERS TOPIC
log-query   START END APP PLUGIN LEVEL DOCTYPE OUTPUT INPUT DIRS [KEYWORDS]
histogram   START END APP PLUGIN LEVEL DOCTYPE OUTPUT INPUT DIRS WINDOW [KEYWORDS]
saved-search SIGNATURE START END WINDOW INPUT SIGNATURES ROOT JOB
saved-searches JOBS INPUT SIGNATURES ROOT
compact     START END ROOT TARGET

Times are epoch seconds and KEYWORDS are separated by bars. INPUT is a log store, a compacted
dataset, or any ORC logs of one layout; with ``--compacted TARGET`` a log store is read together
with its compacted days. ``--apply-origin`` makes APP, PLUGIN and DOCTYPE restrict a query;
without it they are taken and have no effect. DIRS never has one: partitions are pruned.
A saved search runs the log query and the histogram of a signature in one scan; SIGNATURES is
a Parquet table of them with keywords as JSON text, and results go below ROOT under JOB.
Saved searches run together share one scan; JOBS is a JSON file with a line per job: jobId,
signatureId, startTime, endTime, and where wanted histogramWindow and literalKeywords.
``--tie-breakers`` names fields, joined by commas, that order rows of one second.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from logweir.operators.catalog import decode_signatures
from logweir.operators.filters import ANY
from logweir.plans.log_query import LogQuery, run_histogram, run_log_query
from logweir.plans.saved_search import JobRequest, run_signature, run_signatures
from logweir.session import prepare
from logweir.sources.kafka import MAX_OFFSETS, read_topic
from logweir.sources.log_store import (
    compact_days,
    read_compacted,
    read_log_stores,
    read_logs,
    read_orc_logs,
)
from logweir.sources.result_store import ROWS_PER_PART
from logweir.sources.storage import exists
from logweir.streaming.ingest import start_ingest


PENDING_JOB = (
    "jobId string, signatureId string, startTime long, endTime long, "
    "histogramWindow string, literalKeywords boolean"
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(
        description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    jobs = top.add_subparsers(dest="job", required=True)

    ingest = jobs.add_parser("ingest")
    for name in ("checkpoint", "output", "brokers", "topic"):
        ingest.add_argument(name)
    ingest.add_argument("--max-offsets", type=int, default=MAX_OFFSETS)

    for job in ("log-query", "histogram"):
        query = jobs.add_parser(job)
        query.add_argument("start", type=int)
        query.add_argument("end", type=int)
        for name in ("app", "plugin", "level", "doc_type", "output", "input", "dirs"):
            query.add_argument(name)
        if job == "histogram":
            query.add_argument("window")
        query.add_argument("keywords", nargs="?", default="")
        query.add_argument("--apply-origin", action="store_true")
        query.add_argument("--compacted")

    saved = jobs.add_parser("saved-search")
    saved.add_argument("signature")
    saved.add_argument("start", type=int)
    saved.add_argument("end", type=int)
    for name in ("window", "input", "signatures", "root", "job_id"):
        saved.add_argument(name)
    saved.add_argument("--literal", action="store_true")

    pending = jobs.add_parser("saved-searches")
    for name in ("jobs", "input", "signatures", "root"):
        pending.add_argument(name)

    for job in (saved, pending):
        job.add_argument("--compacted")
        job.add_argument("--tie-breakers", type=lambda text: tuple(text.split(",")), default=())
        job.add_argument("--rows-per-part", type=int, default=ROWS_PER_PART)

    compact = jobs.add_parser("compact")
    compact.add_argument("start", type=int)
    compact.add_argument("end", type=int)
    compact.add_argument("root")
    compact.add_argument("target")
    return top


def open_logs(
    spark: SparkSession,
    path: str,
    span: tuple[int, int],
    compacted: str | None = None,
    keywords: str = "",
) -> DataFrame:
    if compacted:
        return read_logs(spark, path, compacted, span=span, keywords=keywords)
    if exists(spark, f"{path}/logs"):
        return read_log_stores(spark, path, span=span)
    if exists(spark, f"{path}/manifest"):
        return read_compacted(spark, path, span=span, keywords=keywords)
    return read_orc_logs(spark, path)


def read_requests(spark: SparkSession, path: str) -> dict[str, JobRequest]:
    """Pending jobs by id, of a JSON file with a line for each."""
    lines = spark.read.schema(PENDING_JOB).json(path).collect()
    return {
        row["jobId"]: JobRequest(
            row["signatureId"],
            row["startTime"],
            row["endTime"],
            row["histogramWindow"] or JobRequest.histogram_window,
            bool(row["literalKeywords"]),
        )
        for row in lines
    }


def run(spark: SparkSession, arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    prepare(spark)
    if args.job == "ingest":
        topic = read_topic(spark, args.brokers, args.topic, args.max_offsets)
        start_ingest(topic, args.output, args.checkpoint).awaitTermination()
        return
    if args.job == "compact":
        compact_days(spark, args.root, args.target, args.start, args.end)
        return
    if args.job == "saved-search":
        logs = open_logs(spark, args.input, (args.start, args.end), args.compacted)
        signatures = decode_signatures(spark.read.parquet(args.signatures))
        request = JobRequest(args.signature, args.start, args.end, args.window, args.literal)
        run_signature(
            logs,
            signatures,
            request,
            args.root,
            args.job_id,
            tie_breakers=args.tie_breakers,
            rows_per_part=args.rows_per_part,
        )
        return
    if args.job == "saved-searches":
        requests = read_requests(spark, args.jobs)
        if not requests:
            return
        span = (
            min(r.start_time for r in requests.values()),
            max(r.end_time for r in requests.values()),
        )
        run_signatures(
            open_logs(spark, args.input, span, args.compacted),
            decode_signatures(spark.read.parquet(args.signatures)),
            requests,
            args.root,
            tie_breakers=args.tie_breakers,
            rows_per_part=args.rows_per_part,
        )
        return
    query = LogQuery(
        args.start,
        args.end,
        args.level,
        args.keywords,
        app_name=args.app if args.apply_origin else ANY,
        plugin=args.plugin if args.apply_origin else ANY,
        doc_type=args.doc_type if args.apply_origin else ANY,
    )
    span = (args.start, args.end)
    logs = open_logs(spark, args.input, span, args.compacted, args.keywords)
    if args.job == "histogram":
        run_histogram(logs, query, args.window, args.output)
    else:
        run_log_query(logs, query, args.output)


if __name__ == "__main__":
    session = SparkSession.builder.appName("logweir").getOrCreate()
    run(session)
    session.stop()
