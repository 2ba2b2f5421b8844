"""Message stream of a Kafka topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Messages of a batch at most, so that a backlog is not one batch.
MAX_OFFSETS = 5_000_000


def read_topic(
    spark: SparkSession,
    brokers: str,
    topic: str,
    max_offsets_per_trigger: int | None = MAX_OFFSETS,
) -> DataFrame:
    """Stream of a topic from its first offset on; offsets lost by the broker are skipped.

    Needs the Kafka connector of Spark on the class path. ``max_offsets_per_trigger`` limits a
    batch, not what is read in all; ``None`` takes whatever is there as one batch.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false")
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load()
