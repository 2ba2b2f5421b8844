"""What the physical plans must and must not contain."""

import re
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from frames import epoch, values
from logweir.operators import parse
from logweir.plans.log_query import (
    LogQuery,
    gathered,
    log_histogram,
    log_query,
    matches_of_searches,
    matching_logs,
)
from logweir.schemas import DEFAULT_PAYLOAD, registered_schemas
from logweir.sources import log_store
from logweir.sources import result_store as results
from logweir.sources.layouts import STANDARD_STRATEGY
from logweir.sources.storage import new_path
from logweir.streaming.ingest import land_batch
from test_ingest import message, messages, payload

SPAN = (epoch(2024, 1, 5), epoch(2024, 1, 6))
QUERY = LogQuery(*SPAN, "INFO", ["log"])


def plan_of(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def line(plan, name):
    return "\n".join(re.findall(rf"^{name}: .*$", plan, re.MULTILINE))


@pytest.fixture(scope="module")
def root(spark):
    origins = [("t", "p"), ("syslog", "linux"), ("ESLogs", "web")]
    texts = [
        message(*origin, payload(f"log {day}", f"2024-0{month}-{day:02d}T05:00:00Z"))
        for origin in origins
        for month in (1, 2)
        for day in range(1, 8)
    ]
    path = new_path(spark, "plans")
    land_batch(messages(spark, texts), path, "s", 0)
    return path


def test_searches_share_one_pruned_scan(spark, root):
    queries = [
        QUERY,
        LogQuery(epoch(2024, 1, 6), epoch(2024, 1, 7), "INFO", ["6", "7"]),
        LogQuery(epoch(2024, 2, 1), epoch(2024, 2, 1)),
    ]
    logs = log_store.read_log_store(spark, root)
    found = matches_of_searches(logs, queries)
    plan = plan_of(found)
    assert len(re.findall(r"^\(\d+\) Scan orc", plan, re.MULTILINE)) == 1
    assert "Exchange" not in plan
    single = [(i, r) for i, q in enumerate(queries) for r in values(matching_logs(logs, q), "message")]
    assert sorted(values(found, "_search", "message")) == sorted(single)
    assert {i for i, _ in single} == {0, 1, 2}


def test_query_prunes_and_pushes_down(spark, root):
    plan = plan_of(log_query(log_store.read_log_store(spark, root), QUERY))
    assert "make_date(year" in line(plan, "PartitionFilters")
    pushed = line(plan, "PushedFilters")
    assert "EqualTo(data.level,info)" in pushed and "GreaterThanOrEqual(data.time" in pushed
    assert plan.count("Exchange (") == 1


def test_shallow_layouts_prune_as_far_as_they_go(spark, root):
    by_month = plan_of(log_query(log_store.read_log_store(spark, root, "ESLogs"), QUERY))
    assert "((year#" in line(by_month, "PartitionFilters")
    assert "GreaterThanOrEqual(data.time" in line(by_month, "PushedFilters")
    undated = plan_of(log_query(log_store.read_log_store(spark, root, "syslog"), QUERY))
    assert "GreaterThanOrEqual(year" in line(undated, "PushedFilters")


def test_span_limits_what_is_listed(spark, root):
    everything = log_store.read_log_store(spark, root)
    limited = log_store.read_log_store(spark, root, span=SPAN)
    assert (len(everything.inputFiles()), len(limited.inputFiles())) == (14, 2)
    assert values(log_query(limited, QUERY), "message") == ["log 5", "log 6"]


def test_histogram_reads_three_fields_and_counts_before_the_shuffle(spark, root):
    plan = plan_of(log_histogram(log_store.read_log_store(spark, root), QUERY, "1 hour"))
    fields = "struct<data:struct<level:string,time:timestamp,message:string>>"
    assert line(plan, "ReadSchema") == f"ReadSchema: {fields}"
    assert "partial_count" in plan


def test_payload_is_parsed_once(spark):
    rows = parse.decode_envelope(messages(spark, [message(payload=payload("x"))]))
    logs = parse.typed_logs(rows, registered_schemas())
    executed = logs._jdf.queryExecution().executedPlan().toString()
    assert executed.count("from_json(") == 2


def test_page_reads_the_parts_it_needs(spark):
    path = new_path(spark, "pages")
    rows = spark.range(1_000).select("id", (F.col("id") % 97).alias("timestamp"))
    results.write_result(rows, path, rows_per_part=50)
    plan = plan_of(results.offset_page(spark, path, 401, 420))
    scan = next(s for s in re.split(r"\n\n+", plan) if s.lstrip().startswith("(") and "Scan orc" in s)
    assert "part_id" in line(scan, "PartitionFilters")
    assert "LessThanOrEqual(local_idx" in line(scan, "PushedFilters")
    # Offsets are stored: a page needs no window and no join with the index.
    assert "Window" not in plan and "Join" not in plan


def test_long_part_index_is_not_broadcast_by_hint(spark, monkeypatch):
    path = new_path(spark, "pages")
    rows = spark.range(100).select("id", F.col("id").alias("timestamp"))
    results.write_result(rows, path, rows_per_part=10)
    monkeypatch.setattr("logweir.operators.parts.BROADCAST_PARTS", 0)
    monkeypatch.setattr(results, "LISTED_DIRECTORIES", 0)
    page = results.offset_page(spark, path, 15, 44)
    assert "ResolvedHint" not in page._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in page._jdf.queryExecution().toString()
    assert values(page, "id") == list(range(14, 44))


def test_sort_spreads_repeated_rows(spark):
    """A line repeated in one second does not gather in one range of the sort."""
    same = F.struct(F.lit(SPAN[0]).cast("timestamp").alias("time"), F.lit("log").alias("message"))
    rows = spark.range(0, 8_000, 1, 8).select(same.alias("data"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = log_query(rows, LogQuery(*SPAN, keywords=["log"]))
        sizes = values(found.groupBy(F.spark_partition_id()).count(), "count")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 8_000 and max(sizes) < 2_000


def test_few_matches_are_gathered_before_they_are_written(spark, root):
    logs = log_store.read_log_store(spark, root)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(gathered(matching_logs(logs, QUERY), QUERY))
    everything = LogQuery(*SPAN)
    assert "Exchange" not in plan_of(gathered(matching_logs(logs, everything), everything))


def test_sorted_write_does_not_sort_again(spark, root):
    """Files hold their rows in time order, which a second sort would not promise."""
    path = new_path(spark, "pages")
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("timestamp"))
    results.write_result(rows, path, rows_per_part=100)
    for file in spark.read.orc(f"{results.read_commit(spark, path).base}/result").inputFiles():
        stored = spark.read.orc(file).select("local_idx")
        assert [r[0] for r in stored.collect()] == list(range(stored.count()))


def rows_scanned(df):
    """Rows a query took out of its scan, which has no shuffle."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("field", log_store.LOOKED_UP)
def test_rare_values_skip_groups_of_rows(spark, field):
    """Its neighbours in every group of rows lie on both sides of the rare value."""
    number = F.col("id")
    usual = F.when(number % 2 == 0, "a").otherwise("z")
    given = {
        "time": F.timestamp_seconds(number + epoch(2024, 3, 1)),
        "message": F.concat(F.lit("log "), number),
        field: F.when(number == 35_000, "m").otherwise(usual),
    }
    fields = [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DEFAULT_PAYLOAD.fields
    ]
    rows = spark.range(60_000).select(F.struct(*fields).alias("data"))
    rows = rows.withColumns({"_documentType": F.lit("t"), "_plugin": F.lit("p")})
    path = new_path(spark, "bloom")
    levels = STANDARD_STRATEGY.default
    log_store.write_batch(parse.add_calendar(rows), path, "s", 0, levels)
    stored = spark.read.orc(path).select("data")
    rare = stored.filter(F.col(f"data.{field}") == "m")
    assert values(rare, "data.message") == ["log 35000"]
    assert 1 <= rows_scanned(rare) <= 20_000
    assert rows_scanned(stored.filter(F.col(f"data.{field}") == "a")) == 60_000
