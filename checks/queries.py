"""One query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from logweir.functions.columns import base_name, epoch_seconds, progress_status, render_times
from logweir.operators import catalog, filters, parse, parts
from logweir.operators.histogram import time_histogram
from logweir.plans.browse import browse
from logweir.plans.jobs import job_listing as listing_of_jobs
from logweir.plans.log_query import (
    HISTOGRAM,
    LOG_QUERY,
    LogQuery,
    flatten,
    histogram_of_store,
    log_histogram,
    log_query,
    matching_logs,
    run_histogram,
    run_log_query,
)
from logweir.plans.saved_search import (
    JobRequest,
    query_of,
    result_path,
    run_signature,
    run_signatures,
)
from logweir.schemas import registered_schemas
from logweir.session import prepare
from logweir.sources import log_store, result_store
from logweir.sources.layouts import STANDARD_STRATEGY
from logweir.sources.storage import exists, new_path
from logweir.streaming.ingest import land_batch, start_ingest

START, END = 1704844800, 1705017600  # 2024-01-10 and 2024-01-12, both at midnight
WHOLE = LogQuery(1704067200, 1706745599)  # January 2024
SEARCH = LogQuery(START, END, level="ERROR", keywords=["69", "8"])
TIES = ("event_id",)
# Keywords, and whether they are plain texts.
INDEXED = (
    ("text", ["k\": 69", "k\": 7}"], True),
    ("pattern", [r'^\{"k": (1|4)[0-3]+', r'k": 99?\}'], False),
    ("no text", ["69", "8"], False),
)
FILES_PER_BATCH = 10_000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _registered(query: Query) -> Query:
    """Register under the function's name (a trailing underscore keeps it off an import)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)

    _QUERIES[query.__name__.rstrip("_")] = run
    return query


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


_WRITTEN: dict[tuple, str] = {}


def _written_once(write: Callable[[SparkSession, str], str]) -> Callable[[SparkSession, str], str]:
    """Keep the path a function wrote to, for the other queries of the session to read."""

    def path_of(spark: SparkSession, sf_dir: str) -> str:
        key = (write.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _WRITTEN or not exists(spark, _WRITTEN[key]):
            _WRITTEN[key] = write(spark, sf_dir)
        return _WRITTEN[key]

    return path_of


def _eighth(rows: DataFrame, at_least: int) -> int:
    """Rows per part that give about eight parts, whatever the size of the table."""
    return max(at_least, rows.count() // 8)


# ---------------------------------------------------------------- log query


@_registered
def log_query_(spark, sf_dir):
    """Time range, level and keywords, sorted by time."""
    return log_query(views.logs(spark, sf_dir), SEARCH, TIES)


@_registered
def log_query_default_order(spark, sf_dir):
    return log_query(views.logs(spark, sf_dir), LogQuery(START, END, level="view"))


@_registered
def log_query_any_level(spark, sf_dir):
    """``*`` switches the level off."""
    return log_query(views.logs(spark, sf_dir), LogQuery(START, START, "*", "1|2"), TIES)


@_registered
def log_query_with_app_filter(spark, sf_dir):
    query = LogQuery(START, END, app_name="app3", plugin="linux", doc_type="syslog")
    return log_query(views.logs(spark, sf_dir), query, TIES)


def _orders_between(spark, sf_dir, start, end):
    rows = filters.in_calendar_range(views.dated_orders(spark, sf_dir), start, end)
    return rows.select("o_orderkey", epoch_seconds(F.col("_time")).alias("timestamp"))


@_registered
def calendar_range_cross_year(spark, sf_dir):
    return _orders_between(spark, sf_dir, 848016000 + 3600, 886636800 + 7200)


@_registered
def calendar_range_adjacent_months(spark, sf_dir):
    return _orders_between(spark, sf_dir, 821232000, 824774400)


@_registered
def calendar_range_one_day(spark, sf_dir):
    return _orders_between(spark, sf_dir, 825552000, 825552000 + 86399)


@_registered
def calendar_range_months_apart(spark, sf_dir):
    return _orders_between(spark, sf_dir, 825552000, 841449600)


@_registered
def level_filter(spark, sf_dir):
    rows = filters.by_level(views.logs(spark, sf_dir), "Purchase")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@_registered
def keyword_regex(spark, sf_dir):
    """Long messages against several patterns at once."""
    documents = views.table(spark, sf_dir, "documents")
    words = ["[0-9]{3}-[0-9]{4}", "@[a-z]+", "^Then"]
    return filters.by_keywords(documents, words, "text").select("doc_id", "lang", "n_chars")


@_registered
def keyword_literal(spark, sf_dir):
    """Plain substrings, among them characters a pattern would give a meaning."""
    documents = views.table(spark, sf_dir, "documents")
    words = ["(c)", "que.", "$"]
    return filters.by_keywords(documents, words, "text", literal=True).select("doc_id", "lang")


# ---------------------------------------------------------------- aggregates


@_registered
def histogram(spark, sf_dir):
    query = LogQuery(WHOLE.start_time, WHOLE.end_time, level="error", keywords=["8"])
    return log_histogram(views.logs(spark, sf_dir), query, "1 hour")


@_registered
def histogram_by_day(spark, sf_dir):
    return time_histogram(matching_logs(views.logs(spark, sf_dir), WHOLE), 86400)


@_registered
def result_stats(spark, sf_dir):
    """Row count of a query, from its stored statistics."""
    path = new_path(spark, "check")
    run_log_query(views.logs(spark, sf_dir), SEARCH, path, TIES)
    return result_store.read_statistics(spark, path)


def _daily(spark, sf_dir):
    rows = flatten(views.logs(spark, sf_dir))
    return parts.part_metadata(rows.withColumn("day", F.dayofmonth("time").cast("long")), "day")


@_registered
def part_metadata(spark, sf_dir):
    return _daily(spark, sf_dir)


@_registered
def running_offset_index(spark, sf_dir):
    return parts.offset_index(_daily(spark, sf_dir), "day")


@_registered
def part_overlap_clip(spark, sf_dir):
    index = parts.offset_index(_daily(spark, sf_dir), "day")
    return parts.overlapping_parts(index, START + 4000, END + 5000, "Timestamp").select(
        "day", "startTimestamp", "endTimestamp"
    )


@_registered
def part_overlap_clip_by_offset(spark, sf_dir):
    index = parts.offset_index(_daily(spark, sf_dir), "day")
    return parts.overlapping_parts(index, 250, 700, "Offset").select(
        "day", "startOffset", "endOffset"
    )


# ---------------------------------------------------------------- stored results


@_written_once
def _stored_logs(spark, sf_dir):
    """All logs as a stored result."""
    path = new_path(spark, "check")
    logs = views.logs(spark, sf_dir)
    rows_per_part = min(result_store.ROWS_PER_PART, _eighth(logs, 1_000))
    run_log_query(logs, WHOLE, path, TIES, rows_per_part)
    return path


@_written_once
def _stored_shipments(spark, sf_dir):
    """A large result with hundreds of rows per timestamp."""
    path = new_path(spark, "check")
    rows = views.shipments(spark, sf_dir)
    ties = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows_per_part = min(result_store.ROWS_PER_PART, _eighth(rows, 1_000))
    result_store.write_result(rows, path, ties, rows_per_part)
    return path


_SHOWN = ("event_id", "level", "message", "timestamp")


@_registered
def stored_result(spark, sf_dir):
    """A whole result, each row with its offset."""
    path = _stored_logs(spark, sf_dir)
    return result_store.read_result(spark, path).select(*_SHOWN, "offset")


@_registered
def stored_part_totals(spark, sf_dir):
    """Metadata read back from the store; its sums do not depend on where parts end."""
    path = _stored_logs(spark, sf_dir)
    return result_store.read_metadata(spark, path).agg(
        F.sum("count").alias("n"),
        F.min("startTimestamp").alias("first_timestamp"),
        F.max("endTimestamp").alias("last_timestamp"),
    )


def _matches_index(index, rows):
    """Whether parts hold what the metadata says of them, and how many rows they hold."""
    facts = F.struct("count", "startTimestamp", "endTimestamp")
    scanned = parts.part_metadata(rows).select("part_id", facts.alias("scanned"))
    compared = index.join(scanned, "part_id", "full_outer")
    same = F.coalesce(facts == F.col("scanned"), F.lit(False))
    return compared.agg(F.sum("count").alias("n"), F.every(same).alias("same"))


@_registered
def stored_parts_match_index(spark, sf_dir):
    path = _stored_logs(spark, sf_dir)
    rows = result_store.read_parts(spark, path)
    return _matches_index(result_store.read_metadata(spark, path), rows)


@_registered
def named_parts_match_index(spark, sf_dir):
    """Parts read by number. How many rows they have is up to the range partitioning."""
    path = _stored_logs(spark, sf_dir)
    rows = result_store.read_parts(spark, path, [0, 2])
    index = result_store.read_metadata(spark, path).filter(F.col("part_id").isin(0, 2))
    return _matches_index(index, rows).select("same")


@_registered
def offset_page(spark, sf_dir):
    path = _stored_logs(spark, sf_dir)
    return result_store.offset_page(spark, path, 290, 610).select(*_SHOWN, "offset")


@_registered
def offset_page_of_shipments(spark, sf_dir):
    return result_store.offset_page(spark, _stored_shipments(spark, sf_dir), 2_901, 4_100)


@_registered
def time_slice(spark, sf_dir):
    return filters.in_time_slice(flatten(views.logs(spark, sf_dir)), START, END).select(*_SHOWN)


def _chunk_rows(spark, sf_dir):
    return _eighth(views.table(spark, sf_dir, "events"), 100)


@_registered
def time_page(spark, sf_dir):
    path = _stored_logs(spark, sf_dir)
    page = result_store.time_page(spark, path, START, END, 11, 60)
    return page.rows.select(*_SHOWN, "offset", F.lit(page.total).cast("long").alias("total"))


@_registered
def saved_slice_page(spark, sf_dir):
    """A page of a slice saved before."""
    path = _stored_logs(spark, sf_dir)
    slice_id, _ = result_store.save_time_slice(spark, path, START, START + 864000)
    page = result_store.slice_page(spark, path, slice_id, 95, 1400)
    return page.rows.select(*_SHOWN, "offset", F.lit(page.total).cast("long").alias("total"))


@_written_once
def _whole_slice(spark, sf_dir):
    """All of a result exported as one slice."""
    path = _stored_logs(spark, sf_dir)
    slice_id, _ = result_store.export_time_slice(
        spark, path, WHOLE.start_time, WHOLE.end_time, _chunk_rows(spark, sf_dir)
    )
    return f"{path}/slices/{slice_id}"


@_registered
def fixed_chunks(spark, sf_dir):
    """Chunks as they were written: the rows and bounds of each."""
    chunks = spark.read.parquet(_whole_slice(spark, sf_dir))
    return chunks.groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("position").alias("startOffset"),
        F.max("position").alias("endOffset"),
        F.min("timestamp").alias("first_timestamp"),
    )


@_registered
def chunk_index(spark, sf_dir):
    """The stored index of a slice's chunks."""
    path, _, slice_id = _whole_slice(spark, sf_dir).rpartition("/slices/")
    index = result_store.read_chunk_index(spark, path, slice_id)
    return index.select("partName", "startOffset", "endOffset")


@_registered
def chunks_by_number(spark, sf_dir):
    """Two chunks of a slice, read by number."""
    path, _, slice_id = _whole_slice(spark, sf_dir).rpartition("/slices/")
    rows = result_store.read_chunks(spark, path, slice_id, 1, 2)
    return rows.select(*_SHOWN, "position", "chunk_id")


@_written_once
def _job(spark, sf_dir):
    """A job run from a saved search, and its id."""
    root = new_path(spark, "check")
    signatures = catalog.decode_signatures(views.raw_signatures(spark, sf_dir))
    request = JobRequest("sig_0", START, END, "1 hour")
    # Its keywords are words of a product name, which no log line holds; search digits.
    digits = F.when(F.col("signatureId") == "sig_0", F.array(F.lit("69"), F.lit("8")))
    signatures = signatures.withColumn("keywords", F.coalesce(digits, "keywords"))
    run_signature(
        views.logs(spark, sf_dir),
        signatures,
        request,
        root,
        "job_9",
        tie_breakers=TIES,
        rows_per_part=100_000,
    )
    return root


@_registered
def browse_whole_result(spark, sf_dir):
    page = browse(spark, _job(spark, sf_dir), "job_9", LOG_QUERY)
    total = F.lit(page.total).cast("long").alias("total")
    return page.rows.select("event_id", "level", "time", "offset", total)


@_registered
def browse_by_time(spark, sf_dir):
    page = browse(
        spark,
        _job(spark, sf_dir),
        "job_9",
        LOG_QUERY,
        "time",
        start=2,
        end=9,
        start_timestamp=START,
        end_timestamp=START + 43200,
    )
    total = F.lit(page.total).cast("long").alias("total")
    return page.rows.select("event_id", "level", "time", "offset", total)


@_registered
def run_signature_(spark, sf_dir):
    """Every query type of a saved search: the rows each has stored."""
    root = _job(spark, sf_dir)
    stored = [
        result_store.read_job_statistics(spark, root, t).withColumn("type", F.lit(t))
        for t in (LOG_QUERY, HISTOGRAM)
    ]
    return stored[0].unionByName(stored[1])


PENDING = {
    "job_a": JobRequest("sig_0", START, END, "1 hour"),
    "job_b": JobRequest("sig_3", START - 172800, START, "6 hours"),
    "job_c": JobRequest("sig_8", WHOLE.start_time, WHOLE.end_time, "1 day"),
}


@_written_once
def _shared_jobs(spark, sf_dir):
    """Pending jobs of several signatures, each with words of its own, run over one scan."""
    root = new_path(spark, "check")
    signatures = catalog.decode_signatures(views.raw_signatures(spark, sf_dir))
    number = F.substring_index("signatureId", "_", -1).cast("long")
    words = F.array((number % 10).cast("string"), (number % 37 + 60).cast("string"))
    run_signatures(
        views.logs(spark, sf_dir),
        signatures.withColumn("keywords", words),
        PENDING,
        root,
        tie_breakers=TIES,
        rows_per_part=_eighth(views.table(spark, sf_dir, "events"), 100),
    )
    return root


@_registered
def run_signatures_shared(spark, sf_dir):
    """What each of the jobs run together has stored."""
    root = _shared_jobs(spark, sf_dir)
    results = [
        result_store.read_result(spark, result_path(root, job, LOG_QUERY)).select(
            F.lit(job).alias("jobId"), "event_id", "level", "timestamp", "offset"
        )
        for job in PENDING
    ]
    return reduce(DataFrame.unionByName, results)


@_registered
def run_signatures_shared_histograms(spark, sf_dir):
    root = _shared_jobs(spark, sf_dir)
    results = [
        result_store.read_result(spark, result_path(root, job, HISTOGRAM)).select(
            F.lit(job).alias("jobId"), "count", "timestamp", "offset"
        )
        for job in PENDING
    ]
    return reduce(DataFrame.unionByName, results)


@_registered
def run_signature_histogram(spark, sf_dir):
    page = browse(spark, _job(spark, sf_dir), "job_9", HISTOGRAM, "offset", start=3, end=30)
    return page.rows


@_registered
def stored_histogram(spark, sf_dir):
    path = new_path(spark, "check")
    run_histogram(views.logs(spark, sf_dir), WHOLE, "6 hours", path)
    return result_store.read_result(spark, path).select("count", "timestamp", "offset")


# ---------------------------------------------------------------- catalogue


def _signatures(spark, sf_dir):
    return catalog.decode_signatures(views.raw_signatures(spark, sf_dir))


def _with_words(signatures):
    return signatures.withColumn("keywords", F.array_join("keywords", ","))


@_registered
def decode_signatures(spark, sf_dir):
    return _signatures(spark, sf_dir).select(
        "signatureId",
        "logLevel",
        F.size("keywords").cast("long").alias("n_keywords"),
        F.element_at("keywords", 1).alias("first_keyword"),
    )


@_registered
def signature_search(spark, sf_dir):
    """By id or keyword: each search once."""
    found = catalog.search_signatures(_signatures(spark, sf_dir), "7$", "^red$")
    return _with_words(found).select("signatureId", "plugin", "logLevel", "docType", "keywords")


@_registered
def signature_search_by_keyword(spark, sf_dir):
    found = catalog.search_signatures(_signatures(spark, sf_dir), keyword="^bo|ring")
    return _with_words(found).select("signatureId", "keywords")


@_registered
def signature_search_all(spark, sf_dir):
    return catalog.search_signatures(_signatures(spark, sf_dir)).select("signatureId")


@_registered
def signature_page(spark, sf_dir):
    """Id matches come first, so the page holds the end of them and then keyword matches."""
    page, total = catalog.signature_page(_signatures(spark, sf_dir), "5$", "red", 11, 60)
    return page.select("signatureId", F.lit(total).cast("long").alias("total"))


@_registered
def signature_page_deep(spark, sf_dir):
    """The last rows of all, past every other."""
    signatures = _signatures(spark, sf_dir)
    _, total = catalog.signature_page(signatures, "5$", "red", 1, 1)
    page, _ = catalog.signature_page(signatures, "5$", "red", total - 24, total + 9)
    return page.select("signatureId", F.lit(total).cast("long").alias("total"))


@_registered
def signature_lookup(spark, sf_dir):
    found = catalog.signature_by_id(_signatures(spark, sf_dir), "sig_42")
    return _with_words(found).select("signatureId", "plugin", "docType", "keywords")


@_registered
def run_signature_matches(spark, sf_dir):
    """The keywords of a saved search, applied to all product names as messages."""
    query = query_of(_signatures(spark, sf_dir), JobRequest("sig_4", START, END))
    products = views.table(spark, sf_dir, "part")
    return filters.by_keywords(products, query.keywords, "p_name").select("p_partkey")


@_registered
def job_listing(spark, sf_dir):
    jobs = catalog.decode_jobs(views.raw_jobs(spark, sf_dir))
    listed = catalog.list_jobs(jobs, "2-HIGH", "^run [FO][0-4]")
    return listed.select(
        "jobId",
        "jobName",
        "appName",
        F.col("logQueryProgress.percentage").alias("percentage"),
        F.col("logQueryProgress.status").alias("status"),
        F.col("histogramProgress.status").alias("histogram_status"),
        F.col("jobDetails.signatureId").alias("signatureId"),
        F.col("jobDetails.startTime").alias("startTime"),
        F.col("logQueryStatistics.totalRowCount").alias("n"),
        epoch_seconds(F.col("createdTime")).alias("created"),
    )


@_registered
def job_status_counts(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    status = progress_status(F.col("o_orderkey") % 1000).alias("status")
    return orders.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


@_registered
def job_stored_statistics(spark, sf_dir):
    """Statistics of completed jobs, filled from the results stored under their ids."""
    root = new_path(spark, "check")
    logs = views.logs(spark, sf_dir)
    run_log_query(logs, SEARCH, f"{root}/job_100_{LOG_QUERY}", TIES)
    run_log_query(logs, WHOLE, f"{root}/job_1100_{LOG_QUERY}", TIES)
    stored = result_store.read_job_statistics(spark, root, LOG_QUERY)
    jobs = catalog.decode_jobs(views.raw_jobs(spark, sf_dir))
    filled = catalog.with_stored_statistics(jobs, stored, "logQuery")
    return filled.select("jobId", F.col("logQueryStatistics.totalRowCount").alias("n"))


@_registered
def job_listing_with_statistics(spark, sf_dir):
    """All jobs with the row counts of both query types, filled while listing."""
    root = new_path(spark, "check")
    logs = views.logs(spark, sf_dir)
    run_log_query(logs, SEARCH, f"{root}/job_100_{LOG_QUERY}", TIES)
    run_histogram(logs, WHOLE, 3600, f"{root}/job_201_{HISTOGRAM}")
    listed = listing_of_jobs(catalog.decode_jobs(views.raw_jobs(spark, sf_dir)), root)
    return listed.select(
        "jobId",
        F.col("logQueryStatistics.totalRowCount").alias("n"),
        F.col("histogramStatistics.totalRowCount").alias("n_buckets"),
    )


# ---------------------------------------------------------------- ingest


@_registered
def envelope_parse(spark, sf_dir):
    rows = parse.decode_envelope(views.envelopes(spark, sf_dir))
    return rows.groupBy("_documentType", "_plugin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_message").alias("messages"),
        F.count("_raw").alias("unroutable"),
    )


@_registered
def distinct_routing_keys(spark, sf_dir):
    return parse.routing_keys(parse.decode_envelope(views.envelopes(spark, sf_dir)))


@_registered
def routed_split(spark, sf_dir):
    rows = parse.decode_envelope(views.envelopes(spark, sf_dir))
    branches, rest = parse.split_by_route(rows, ["syslog.linux", "ESLogs.web"])
    counted = [
        branch.agg(F.count(F.lit(1)).alias("n")).withColumn("branch", F.lit(key))
        for key, branch in [*branches.items(), ("default", rest)]
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


_LANDED = ("node", "pid", "level", "time", "message", "_tag_appName")


@_registered
def routed_parse(spark, sf_dir):
    """Payloads parsed by two schemas; fields a row's own schema lacks stay null."""
    rows = parse.decode_envelope(views.envelopes(spark, sf_dir)).filter(parse.is_routable())
    logs = parse.typed_logs(rows, registered_schemas(yarn_key="ESLogs.web"))
    return logs.select(
        *[F.col(f"data.{name}").alias(name) for name in (*_LANDED, "host", "yarnContainer")],
        "_documentType",
        "_plugin",
    )


@_registered
def event_calendar(spark, sf_dir):
    rows = parse.decode_envelope(views.envelopes(spark, sf_dir)).filter(parse.is_routable())
    logs = parse.typed_logs(rows, registered_schemas())
    return logs.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@_written_once
def _topic(spark, sf_dir):
    """Files of messages, several even of a small table."""
    path = new_path(spark, "check")
    envelopes = views.envelopes(spark, sf_dir)
    events = views.table(spark, sf_dir, "events")
    envelopes.write.option("maxRecordsPerFile", _eighth(events, 100)).parquet(path)
    return path


def _messages(spark, sf_dir):
    """A stream of the messages in at least two batches, and in more when there are many."""
    path = _topic(spark, sf_dir)
    files = len(spark.read.schema("value binary").parquet(path).inputFiles())
    per_batch = max(1, min(files // 2, FILES_PER_BATCH))
    reader = spark.readStream.schema("value binary").option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


@_written_once
def _streamed(spark, sf_dir):
    """A store filled by a stream."""
    root = new_path(spark, "check")
    query = start_ingest(
        _messages(spark, sf_dir), f"{root}/store", f"{root}/checkpoint", available_now=True
    )
    query.awaitTermination()
    return f"{root}/store"


@_registered
def ingest_stream(spark, sf_dir):
    """All rows a stream landed, from datasets of three layouts."""
    landed = log_store.read_log_stores(spark, _streamed(spark, sf_dir))
    return landed.select(
        *[F.col(f"data.{name}").alias(name) for name in _LANDED],
        "_documentType",
        "_plugin",
        "year",
        "month",
        "day",
    )


@_registered
def ingest_layouts(spark, sf_dir):
    """Which dataset each kind of log went to."""
    root = _streamed(spark, sf_dir)
    counted = [
        log_store.read_log_store(spark, root, layout)
        .groupBy("_documentType", "_plugin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("layout", F.lit(layout))
        for layout in ("default", "syslog", "ESLogs")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@_registered
def ingest_dead_letters(spark, sf_dir):
    dead = log_store.read_dead_letters(spark, _streamed(spark, sf_dir))
    dead = dead.filter("_documentType is null or _plugin is null")
    return dead.groupBy("_documentType", "_plugin").agg(
        F.count(F.lit(1)).alias("n"), F.count("_raw").alias("kept")
    )


@_registered
def ingest_malformed(spark, sf_dir):
    """Texts of payloads that could not be parsed, by their routes."""
    dead = log_store.read_dead_letters(spark, _streamed(spark, sf_dir))
    kept = dead.filter("_documentType is not null and _plugin is not null")
    return kept.groupBy("_documentType", "_plugin").agg(
        F.count(F.lit(1)).alias("n"), F.min("_raw").alias("text")
    )


@_registered
def ingest_replay(spark, sf_dir):
    """Batches landed twice count once."""
    root = new_path(spark, "check")

    def land_twice(batch, batch_id):
        for _ in range(2):
            land_batch(batch, f"{root}/store", "replayed", batch_id)

    writer = _messages(spark, sf_dir).writeStream.foreachBatch(land_twice)
    writer = writer.option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    landed = log_store.read_log_stores(spark, f"{root}/store")
    return landed.groupBy("_documentType").agg(F.count(F.lit(1)).alias("n"))


@_registered
def rollup_histogram(spark, sf_dir):
    """A histogram of a store a stream has filled, from the counts landed with it."""
    query = LogQuery(START, END, "ERROR")
    found = histogram_of_store(spark, _streamed(spark, sf_dir), query, "2 hours")
    return found.select("count", "timestamp")


@_registered
def rollup_histogram_by_origin(spark, sf_dir):
    query = LogQuery(WHOLE.start_time, WHOLE.end_time, app_name="app3", plugin="linux")
    found = histogram_of_store(spark, _streamed(spark, sf_dir), query, 86400)
    return found.select("count", "timestamp")


@_registered
def store_log_query(spark, sf_dir):
    """The log query over a store a stream has filled, across its layouts."""
    store = log_store.read_log_stores(spark, _streamed(spark, sf_dir), span=(START, END))
    found = log_query(store, LogQuery(START, END, "error", ["69", "8"]), ("pid",))
    return found.select("pid", "level", "message", "timestamp")


@_registered
def compacted_log_query(spark, sf_dir):
    """The same after the days of the store have been compacted into one dataset."""
    root = _streamed(spark, sf_dir)
    target = new_path(spark, "check")
    log_store.compact_days(spark, root, target, WHOLE.start_time, WHOLE.end_time)
    store = log_store.read_compacted(spark, target, span=(START, END))
    found = log_query(store, LogQuery(START, END, "error", ["69", "8"]), ("pid",))
    return found.select("pid", "level", "message", "timestamp")


@_written_once
def _mixed(spark, sf_dir):
    """A store whose first days are compacted, after which a late batch has come."""
    root = new_path(spark, "check")
    late = F.col("event_id") % 13 == 0
    land_batch(views.envelopes(spark, sf_dir, ~late), root, "mixed", 0)
    half = START + 86_400
    log_store.compact_days(spark, root, f"{root}/compacted", WHOLE.start_time, half)
    land_batch(views.envelopes(spark, sf_dir, late), root, "mixed", 1)
    return root


@_registered
def mixed_log_query(spark, sf_dir):
    """The same while some days are compacted, others are not, and a batch came late for both."""
    root = _mixed(spark, sf_dir)
    store = log_store.read_logs(spark, root, f"{root}/compacted", span=(START, END))
    found = log_query(store, LogQuery(START, END, "error", ["69", "8"]), ("pid",))
    return found.select("pid", "level", "message", "timestamp")


@_registered
def keyword_indexed(spark, sf_dir):
    """Keywords over compacted and open days: only compacted files are opened that may match.

    By a plain text, an expression with required texts, and one without any.
    """
    root = _mixed(spark, sf_dir)
    found = []
    for kind, words, literal in INDEXED:
        store = log_store.read_logs(
            spark, root, f"{root}/compacted", span=(START, END), keywords=words, literal=literal
        )
        query = LogQuery(START, END, keywords=words, literal_keywords=literal)
        found.append(log_query(store, query).withColumn("kind", F.lit(kind)))
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("kind", "pid", "level", "message", "timestamp")


@_registered
def mixed_store_rows(spark, sf_dir):
    """Every landed row once, whole store, after the late rows have been compacted too."""
    root = _mixed(spark, sf_dir)
    target = new_path(spark, "check")
    for end in (START, END, START + 86_400):
        log_store.compact_days(spark, root, target, WHOLE.start_time, end)
    landed = log_store.read_logs(spark, root, target)
    return landed.groupBy("_documentType", "year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count("data.message").alias("messages")
    )


@_registered
def ingest_partial_batch(spark, sf_dir):
    """A batch of which one dataset is written, as a lost driver leaves it, and its next try."""
    root = new_path(spark, "check")
    odd = F.col("event_id") % 2 == 1
    land_batch(views.envelopes(spark, sf_dir, ~odd), root, "partial", 0)
    rest = views.envelopes(spark, sf_dir, odd)
    rows = parse.decode_envelope(rest).filter(parse.is_routable())
    written = parse.typed_logs(rows.filter("_documentType = 'applog'"), registered_schemas())
    layout = STANDARD_STRATEGY.default
    place = log_store.layout_root(root, "default")
    log_store.write_batch(written, place, "partial", 1, layout)
    before = log_store.read_log_stores(spark, root).withColumn("state", F.lit("before"))
    land_batch(rest, root, "partial", 1)
    after = log_store.read_log_stores(spark, root).withColumn("state", F.lit("after"))
    return (
        before.unionByName(after)
        .groupBy("state", "_documentType")
        .agg(F.count(F.lit(1)).alias("n"), F.count("data.message").alias("messages"))
    )


# ---------------------------------------------------------------- rendering


@_registered
def rendered_times(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return render_times(
        events.select(
            "event_id", F.col("ts").alias("time"), F.date_trunc("hour", "ts").alias("start")
        )
    )


@_registered
def part_basename(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    path = F.concat_ws("/", F.lit("bucket"), F.col("o_orderstatus"), F.col("o_orderkey"))
    return orders.select("o_orderkey", base_name(path).alias("name"))
