"""Counts of landed rows per minute, level and origin, kept beside the logs.

A batch lands its counts with its rows and under the same commit, so a replay changes neither
and readers see both or none::

    rollup/stream_id=<id>/batch_id=<n>/*.orc
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from logweir.sources.layouts import STANDARD_STRATEGY, PartitionStrategy
from logweir.sources.manifest import live_batches, only_batches, read_commits
from logweir.sources.storage import exists

# What a commit counts the rows under that are in the counts.
ROLLUP = "rollup"
FIELDS = ("time", "level", "_tag_appName")

# Fields of a count lie where those of a row do, so the same filters take both.
COUNTS = StructType(
    [
        StructField(
            "data",
            StructType(
                [
                    StructField("time", TimestampType()),
                    StructField("level", StringType()),
                    StructField("_tag_appName", StringType()),
                ]
            ),
        ),
        StructField("_documentType", StringType()),
        StructField("_plugin", StringType()),
        StructField("count", LongType()),
        StructField("stream_id", StringType()),
        StructField("batch_id", LongType()),
    ]
)


def write_rollup(logs: DataFrame, root: str, stream_id: str, batch_id: int) -> None:
    """Write the counts of a batch's rows; those without a time are not counted.

    Combined before the shuffle, so a crowded minute costs no more than a quiet one.
    """
    held = logs.schema["data"].dataType.fieldNames()
    fields = {
        name: F.col(f"data.{name}") if name in held else F.lit(None).cast("string")
        for name in FIELDS
    }
    fields["time"] = F.date_trunc("minute", F.col("data.time").cast("timestamp"))
    counts = (
        logs.filter(F.col("data.time").isNotNull())
        .groupBy(*(v.alias(k) for k, v in fields.items()), "_documentType", "_plugin")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.struct(*FIELDS).alias("data"), "_documentType", "_plugin", "count")
    )
    path = f"{root}/rollup/stream_id={stream_id}/batch_id={batch_id}"
    counts.hint("rebalance").sortWithinPartitions("data.time").write.mode("overwrite").orc(path)


def read_rollup(
    spark: SparkSession,
    root: str,
    span: tuple[int, int],
    strategy: PartitionStrategy = STANDARD_STRATEGY,
) -> DataFrame | None:
    """Counts of all landed batches with rows of these days.

    ``None`` where a batch with rows of these days has none, as those landed before counts
    were kept. Batches of other days are not opened.
    """
    commits = read_commits(spark, root)
    keys = ["stream_id", "batch_id"]
    landed = live_batches(commits, list(strategy.layouts), span).select(*keys)
    counted = live_batches(commits, [ROLLUP], span).select(*keys)
    if not landed.join(counted, keys, "left_anti").isEmpty():
        return None
    if not exists(spark, f"{root}/rollup"):
        return spark.createDataFrame([], COUNTS)
    rows = spark.read.schema(COUNTS).orc(f"{root}/rollup")
    return only_batches(rows, counted).drop(*keys)
