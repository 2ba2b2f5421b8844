import pytest
from pyspark.sql import functions as F

from frames import epoch, log_rows, values
from logweir.plans.browse import browse
from logweir.sources.log_store import layout_root
from logweir.sources.result_store import read_result, read_statistics
from logweir.sources.storage import new_path
from logweir.streaming.ingest import land_batch
from submit import PENDING_JOB, parser, run
from test_ingest import message, messages, payload

START, END = str(epoch(2024, 2, 3)), str(epoch(2024, 2, 4))


@pytest.fixture(scope="module")
def root(spark):
    texts = [
        message("t", "p", payload("disk full", "2024-02-03T09:00:00Z", level="error")),
        message("t", "p", payload("disk ok", "2024-02-03T09:30:00Z")),
        message("syslog", "linux", payload("disk gone", "2024-02-04T00:00:00Z", level="error")),
        message("t", "p", payload("later", "2024-02-05T00:00:00Z", level="error")),
    ]
    path = new_path(spark, "submit")
    land_batch(messages(spark, texts), path, "s", 0)
    return path


def test_log_query_and_histogram(spark, root):
    output = new_path(spark, "jobs")
    common = [START, END, "app", "web", "ERROR", "access"]
    run(spark, ["log-query", *common, f"{output}/j_LogQuery", root, "{2024/2/*}", "disk|net"])
    run(spark, ["histogram", *common, f"{output}/j_Histogram", root, "{2024/2/*}", "3600"])
    page = browse(spark, output, "j", "LogQuery")
    assert values(page.rows, "message") == ["disk full", "disk gone"]
    bars = browse(spark, output, "j", "Histogram")
    assert values(bars.rows, "start", "count") == [
        ("2024-02-03 09:00:00", 1),
        ("2024-02-04 00:00:00", 1),
    ]


def test_origin_applies_on_request(spark, root):
    output = new_path(spark, "jobs")
    arguments = [START, END, "*", "linux", "*", "syslog", output, root, "-"]
    run(spark, ["log-query", *arguments, "--apply-origin"])
    assert values(read_result(spark, output), "message") == ["disk gone"]


def test_logs_of_one_layout_and_compacted_ones(spark, root):
    arguments = [START, END, "*", "*", "*", "*"]
    output = new_path(spark, "jobs")
    run(spark, ["log-query", *arguments, output, layout_root(root, "default"), "-", "disk"])
    assert values(read_statistics(spark, output), "value") == [2]

    target, output = new_path(spark, "compacted"), new_path(spark, "jobs")
    run(spark, ["compact", START, END, root, target])
    run(spark, ["log-query", *arguments, output, target, "-"])
    assert values(read_statistics(spark, output), "value") == [3]


def test_store_written_elsewhere(spark):
    path, output = new_path(spark, "plain"), new_path(spark, "jobs")
    rows = [("2024-02-03 09:00:00", "error", "kept"), ("2024-02-09 09:00:00", "error", "out")]
    logs = log_rows(spark, rows)
    logs.write.partitionBy("_documentType", "_plugin", "year", "month", "day").orc(path)
    run(spark, ["log-query", START, END, "*", "*", "error", "*", output, path, "-"])
    assert values(read_result(spark, output), "message") == ["kept"]


def test_saved_searches_alone_and_together(spark, root):
    saved = [("disk", "p", "ERROR", "t", '["disk.full"]'), ("all", "p", "*", "t", "[]")]
    signatures, jobs = new_path(spark, "signatures"), new_path(spark, "pending")
    columns = "signatureId string, plugin string, logLevel string, docType string, keywords string"
    table = spark.createDataFrame(saved, columns).withColumns(
        {c: F.timestamp_seconds(F.lit(1)) for c in ("createdTime", "lastModifiedTime")}
    )
    table.write.parquet(signatures)
    lines = spark.createDataFrame(
        [
            ("j1", "disk", int(START), int(END), "3600", None),
            ("j2", "all", int(START), int(START), None, None),
            ("j3", "disk", int(START), int(END), None, True),
        ],
        PENDING_JOB,
    )
    lines.write.json(jobs)
    output = new_path(spark, "jobs")
    options = ["--tie-breakers", "message,host", "--rows-per-part", "10"]
    run(spark, ["saved-searches", jobs, root, signatures, output, *options])
    alone = ["saved-search", "disk", START, END, "1 hour", root, signatures, output]
    run(spark, [*alone, "j4", *options])
    run(spark, [*alone, "j5", "--literal"])
    found = {j: values(browse(spark, output, j, "LogQuery").rows, "message") for j in ("j1", "j2", "j4")}
    assert found == {"j1": ["disk full"], "j2": ["disk full", "disk ok"], "j4": ["disk full"]}
    for job in ("j3", "j5"):
        assert values(read_statistics(spark, f"{output}/{job}_LogQuery"), "value") == [0]
    assert values(browse(spark, output, "j2", "Histogram").rows, "count") == [2]


def test_ingest_arguments():
    args = parser().parse_args(["ingest", "c", "o", "b:9092", "t", "--max-offsets", "5"])
    assert (args.checkpoint, args.output, args.max_offsets) == ("c", "o", 5)
