"""The test tables seen as logs, messages, saved searches and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Explicit row types: no footer is read to plan, and times are instants (the zone is UTC).
COLUMNS = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, "
    "props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_shipdate timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
}


# Messages are built by tasks of about this many events.
EVENTS_PER_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _spread(events: DataFrame) -> DataFrame:
    """Deal events over tasks by their number, since a file may be one group of rows.

    The count comes from the footers.
    """
    tasks = events.count() // EVENTS_PER_TASK
    return events.repartition(tasks, "event_id") if tasks > 1 else events


def _doc_type() -> Column:
    return (
        F.when(F.col("event_type") == "error", "syslog")
        .when(F.col("event_type") == "signup", "ESLogs")
        .otherwise("applog")
    )


def _plugin() -> Column:
    return F.when(F.col("user_id") % 2 == 0, "linux").otherwise("web")


def _payload(time: Column) -> list[Column]:
    return [
        F.col("user_id").cast("string").alias("node"),
        _doc_type().alias("_documentType"),
        _plugin().alias("_plugin"),
        F.col("event_id").cast("string").alias("pid"),
        F.concat(F.lit("host"), F.col("user_id") % 10).alias("host"),
        F.col("event_type").alias("level"),
        F.lit("evt").alias("ident"),
        time.alias("time"),
        F.concat(F.lit("app"), F.col("user_id") % 5).alias("_tag_appName"),
        F.col("props").alias("message"),
    ]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of the log store; the payload also carries ``event_id``."""
    events = table(spark, sf_dir, "events")
    payload = F.struct(F.col("event_id"), *_payload(F.col("ts")))
    return events.select(
        payload.alias("data"),
        F.col("ts").alias("_time"),
        _doc_type().alias("_documentType"),
        _plugin().alias("_plugin"),
        *_calendar("ts"),
    )


def _calendar(time: str) -> list[Column]:
    return [
        F.year(time).alias("year"),
        F.month(time).alias("month"),
        F.dayofmonth(time).alias("day"),
    ]


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with calendar columns: dates over several years."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        "o_orderstatus",
        F.col("o_orderdate").alias("_time"),
        *_calendar("o_orderdate"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a large result with many rows per timestamp."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        F.col("l_shipdate").cast("long").alias("timestamp"),
    )


def envelopes(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """``events`` (those of ``only``) as raw messages, with the irregularities real ones have.

    Odd events carry the payload as encoded text, even ones as an object. Every 31st is not
    JSON, the payload of every 7th user names no document type, and the envelope of every
    50th event names no plugin.
    """
    events = _spread(table(spark, sf_dir, "events"))
    events = events if only is None else events.filter(only)
    payload = _payload(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    named = F.when(F.col("user_id") % 7 != 0, _doc_type()).alias("_documentType")
    body = F.struct(payload[0], named, *payload[2:])
    origin = [
        _doc_type().alias("_documentType"),
        F.when(F.col("event_id") % 50 != 0, _plugin()).alias("_plugin"),
    ]
    text = F.when(F.col("event_id") % 31 == 0, F.lit("not json")).otherwise(F.to_json(body))
    as_text = F.to_json(F.struct(*origin, text.alias("message")))
    as_object = F.to_json(F.struct(*origin, body.alias("message")))
    encoded = (F.col("event_id") % 2 == 1) | (F.col("event_id") % 31 == 0)
    value = F.when(encoded, as_text).otherwise(as_object)
    return events.select(value.cast("binary").alias("value"))


def raw_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as the table of saved searches."""
    created = F.timestamp_seconds(F.lit(1_500_000_000) + F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("sig_"), F.col("p_partkey")).alias("signatureId"),
        F.col("p_brand").alias("plugin"),
        F.when(F.col("p_partkey") % 2 == 0, "ERROR").otherwise("*").alias("logLevel"),
        F.col("p_type").alias("docType"),
        F.to_json(F.split("p_name", " ")).alias("keywords"),
        created.alias("createdTime"),
        created.alias("lastModifiedTime"),
    )


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the table of jobs."""

    def progress(percentage: Column) -> Column:
        return F.to_json(F.struct(percentage.alias("percentage")))

    key = F.col("o_orderkey")
    details = F.struct(
        F.concat(F.lit("sig_"), F.col("o_custkey")).alias("signatureId"),
        F.lit(1704844800).alias("startTime"),
        F.lit(1705017600).alias("endTime"),
        F.lit("1 hour").alias("histogramWindow"),
    )
    counted = F.to_json(F.struct(F.col("o_custkey").alias("totalRowCount")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("job_"), key).alias("jobId"),
        F.concat(F.lit("run "), F.col("o_orderstatus"), key % 10).alias("jobName"),
        progress(key % 1000).alias("logQueryProgress"),
        progress(key % 101).alias("histogramProgress"),
        F.col("o_orderdate").alias("createdTime"),
        F.col("o_orderdate").alias("lastModifiedTime"),
        F.to_json(details).alias("jobData"),
        F.col("o_orderpriority").alias("tagAppName"),
        F.when(key % 3 == 0, counted).otherwise("[]").alias("logQueryStatistics"),
        F.lit("[]").alias("histogramStatistics"),
    )
