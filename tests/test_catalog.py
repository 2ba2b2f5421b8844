import pytest
from pyspark.sql import functions as F

from frames import epoch, log_rows, values
from logweir.errors import NotFoundError, ValidationError
from logweir.functions.columns import base_name, progress_status, render_times
from logweir.operators import catalog
from logweir.plans.log_query import HISTOGRAM, LOG_QUERY
from logweir.plans import log_query
from logweir.plans.saved_search import (
    JobRequest,
    query_of,
    result_path,
    run_signature,
    run_signatures,
)
from logweir.schemas import RAW_JOB, RAW_SIGNATURE
from logweir.sources.result_store import read_result
from logweir.sources.storage import new_path


@pytest.fixture(scope="module")
def signatures(spark):
    rows = [
        ("disk-1", "linux", "ERROR", "syslog", '["full", "i/o"]', 1),
        ("disk-2", "linux", "*", "syslog", "[]", 2),
        ("net-1", "web", "warn", "access", '["disk", "timeout"]', 3),
        ("net-2", "web", "*", "access", '["timeout"]', 4),
        ("odd", "web", "*", "access", None, 5),
    ]
    raw = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f long")
    times = raw.withColumn("f", F.timestamp_seconds("f")).withColumn("g", F.col("f"))
    return catalog.decode_signatures(times.toDF(*RAW_SIGNATURE.fieldNames())).cache()


@pytest.mark.parametrize(
    ("signature_id", "keyword", "expected"),
    [
        ("*", "*", ["odd", "net-2", "net-1", "disk-2", "disk-1"]),
        ("^disk", "*", ["disk-2", "disk-1"]),
        ("*", "time", ["net-2", "net-1"]),
        # Both: id matches first, a search that matches twice is listed once.
        ("net-1|disk-1", "time|full", ["net-1", "disk-1", "net-2"]),
        ("none", "*", []),
        ("2$", "disk", ["net-2", "disk-2", "net-1"]),
    ],
)
def test_search(signatures, signature_id, keyword, expected):
    found = catalog.search_signatures(signatures, signature_id, keyword)
    assert values(found, "signatureId") == expected
    page, total = catalog.signature_page(signatures, signature_id, keyword, 2, 3)
    assert values(page, "signatureId") == expected[1:3] and total == len(expected)
    whole, total = catalog.signature_page(signatures, signature_id, keyword)
    assert values(whole, "signatureId") == expected and total == len(expected)


def test_pages_join_up_at_any_depth(spark):
    rows = spark.range(500).select(
        F.concat(F.lit("s"), F.col("id")).alias("signatureId"),
        F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") % 3 * 5_000)).alias(
            "createdTime"
        ),
        F.array(F.lit("k")).alias("keywords"),
    )
    whole = values(catalog.signature_page(rows, "7", "k")[0], "signatureId")
    assert len(whole) == 500
    for start in (1, 90, 167, 480, 499, 700):
        page, total = catalog.signature_page(rows, "7", "k", start, start + 30)
        assert values(page, "signatureId") == whole[start - 1 : start + 30] and total == 500


def test_bad_patterns(signatures):
    with pytest.raises(ValidationError):
        catalog.search_signatures(signatures, "[")
    with pytest.raises(ValidationError):
        catalog.signature_page(signatures, start=3, end=2)
    with pytest.raises(ValidationError):
        catalog.signature_page(signatures, start=0, end=2)


def test_lookup(signatures):
    assert values(catalog.signature_by_id(signatures, "odd"), "docType") == ["access"]
    with pytest.raises(NotFoundError):
        catalog.signature_by_id(signatures, "od")


def test_query_of_a_signature(signatures):
    query = query_of(signatures, JobRequest("disk-1", 5, 9))
    assert (query.start_time, query.end_time, query.level) == (5, 9, "ERROR")
    assert (list(query.keywords), query.plugin, query.doc_type) == (["full", "i/o"], "*", "*")
    assert query_of(signatures, JobRequest("disk-1", 5, 9), apply_origin=True).plugin == "linux"
    assert query_of(signatures, JobRequest("odd", 5, 9)).keywords == ()


def test_run_signature(spark, signatures):
    rows = [
        ("2024-01-01 10:00:00", "error", "disk full"),
        ("2024-01-01 11:00:00", "error", "fine"),
        ("2024-01-01 12:00:00", "error", "i/o wait"),
    ]
    request = JobRequest("disk-1", epoch(2024, 1, 1), epoch(2024, 1, 1), 7200)
    root = new_path(spark, "jobs")
    counts = run_signature(log_rows(spark, rows), signatures, request, root, "j")
    assert counts == {LOG_QUERY: 2, HISTOGRAM: 2}
    found = read_result(spark, result_path(root, "j", LOG_QUERY)).orderBy("offset")
    assert values(found, "message") == ["disk full", "i/o wait"]
    with pytest.raises(ValidationError, match="exists"):
        run_signature(log_rows(spark, rows), signatures, request, root, "j")
    with pytest.raises(ValidationError):
        result_path(root, "j", "Chart")


def _jobs(spark):
    rows = [
        ("j1", "nightly", 100, 0, 1, "a", "[]"),
        ("j2", "nightly 2", 1, 999, 2, "a", "[]"),
        ("j3", "hourly", 99, 100, 3, "b", '{"totalRowCount": 3}'),
        ("j4", "nightly 4", 100, 500, 4, "a", "[]"),
    ]
    raw = spark.createDataFrame(
        rows, "id string, name string, lq int, h int, t long, app string, stats string"
    )
    progress = [
        F.format_string('{"percentage": %d}', c).alias(c) for c in ("lq", "h")
    ]
    time = F.timestamp_seconds("t")
    details = F.lit('{"signatureId": "s", "startTime": 5, "endTime": 6, "histogramWindow": "1 h"}')
    jobs = raw.select(
        "id", "name", *progress, time, time.alias("u"), details, "app", "stats", F.lit("[]")
    )
    return catalog.decode_jobs(jobs.toDF(*RAW_JOB.fieldNames()))


def test_job_listing(spark):
    jobs = _jobs(spark)
    listed = catalog.list_jobs(jobs)
    assert values(listed, "jobId", "logQueryProgress.status", "histogramProgress.status") == [
        ("j4", "COMPLETED", "UNKNOWN"),
        ("j3", "RUNNING", "COMPLETED"),
        ("j2", "RUNNING", "FAILED"),
        ("j1", "COMPLETED", "NOT STARTED"),
    ]
    assert values(catalog.list_jobs(jobs, "a", "y$|4"), "jobId") == ["j4", "j1"]
    assert values(jobs, "jobDetails.endTime", "logQueryStatistics.totalRowCount") == [
        (6, None),
        (6, None),
        (6, 3),
        (6, None),
    ]


def test_statistics_of_completed_jobs(spark):
    rows = [("j1", 12), ("j2", 9), ("j3", 8)]
    stored = spark.createDataFrame(rows, "jobId string, totalRowCount long")
    filled = catalog.with_stored_statistics(_jobs(spark), stored, "logQuery")
    # Only completed jobs that have none yet; without a result the count is 0.
    assert sorted(values(filled, "jobId", "logQueryStatistics.totalRowCount")) == [
        ("j1", 12),
        ("j2", None),
        ("j3", 3),
        ("j4", 0),
    ]


def test_status_words(spark):
    cases = {0: "NOT STARTED", 1: "RUNNING", 99: "RUNNING", 100: "COMPLETED", 999: "FAILED"}
    cases |= {500: "UNKNOWN", -1: "UNKNOWN", None: "UNKNOWN"}
    frame = spark.createDataFrame([(p,) for p in cases], "p int")
    assert values(frame.select(progress_status(F.col("p")))) == list(cases.values())


def test_rendering(spark):
    frame = spark.createDataFrame(
        [("2024-01-01 00:00:00", "x"), ("2024-01-01 00:00:00.12", "y"), (None, "z")],
        "time string, other string",
    )
    typed = frame.withColumn("time", F.col("time").cast("timestamp"))
    assert values(render_times(typed), "time", "other") == [
        ("2024-01-01 00:00:00", "x"),
        ("2024-01-01 00:00:00.120000", "y"),
        (None, "z"),
    ]
    assert render_times(frame.select("other")).columns == ["other"]
    paths = spark.createDataFrame([("a/b/part-0.orc",), ("part-1",)], "p string")
    assert values(paths.select(base_name(F.col("p")))) == ["part-0.orc", "part-1"]


MIXED = [
    (f"2024-01-{day:02d} 10:00:{second:02d}", level, message)
    for day in (1, 2, 3, 5)
    for second, level, message in (
        (1, "error", "disk full"),
        (1, "error", "disk full"),
        (2, "warn", "disk timeout"),
        (3, "info", "timeout"),
        (4, "error", None),
    )
] + [(None, "error", "full")]
PENDING = {
    "a": JobRequest("disk-1", epoch(2024, 1, 1), epoch(2024, 1, 2), 7200),
    "b": JobRequest("net-1", epoch(2024, 1, 2), epoch(2024, 1, 5), "1 day"),
    "c": JobRequest("net-2", epoch(2024, 1, 1), epoch(2024, 1, 31), "1 hour"),
    "d": JobRequest("odd", epoch(2024, 1, 3), epoch(2024, 1, 3), "1 hour"),
    "none": JobRequest("disk-1", epoch(2023, 1, 1), epoch(2023, 1, 1), "1 hour"),
    "again": JobRequest("disk-1", epoch(2024, 1, 1), epoch(2024, 1, 2), 7200),
}


@pytest.mark.parametrize("per_scan", [64, 2])
def test_jobs_run_together_store_what_single_runs_do(spark, signatures, monkeypatch, per_scan):
    monkeypatch.setattr(log_query, "SEARCHES_PER_SCAN", per_scan)
    logs = log_rows(spark, MIXED)
    root, alone = new_path(spark, "jobs"), new_path(spark, "jobs")
    counts = run_signatures(logs, signatures, PENDING, root, rows_per_part=3)
    assert list(counts) == list(PENDING)
    for job, request in PENDING.items():
        expected = run_signature(logs, signatures, request, alone, job, rows_per_part=3)
        assert counts[job] == expected
        for kind in expected:
            one, other = (read_result(spark, result_path(r, job, kind)) for r in (root, alone))
            assert one.schema == other.schema
            assert sorted(values(one), key=repr) == sorted(values(other), key=repr)
    assert counts["none"] == {"LogQuery": 0, "Histogram": 0}
    assert counts["again"] == counts["a"] and counts["a"]["LogQuery"] == 4


def test_jobs_run_together_are_checked_first(spark, signatures):
    logs, root = log_rows(spark, MIXED), new_path(spark, "jobs")
    assert run_signatures(logs, signatures, {}, root) == {}
    with pytest.raises(NotFoundError, match="nowhere"):
        run_signatures(
            logs, signatures, PENDING | {"x": JobRequest("nowhere", 0, 1)}, root
        )
    run_signature(logs, signatures, PENDING["d"], root, "d")
    with pytest.raises(ValidationError, match="exists"):
        run_signatures(logs, signatures, PENDING, root)
    rest = {job: request for job, request in PENDING.items() if job != "d"}
    assert len(run_signatures(logs, signatures, rest, root)) == 5
