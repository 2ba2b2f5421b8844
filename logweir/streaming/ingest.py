"""Land a stream of enveloped messages in the log store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logweir.errors import ConfigurationError
from logweir.operators.parse import (
    decode_envelope,
    finish_logs,
    is_malformed,
    is_routable,
    parse_payload,
)
from logweir.schemas import DEFAULT_PAYLOAD, merged_payload, registered_schemas
from logweir.session import check_session
from logweir.sources.layouts import STANDARD_STRATEGY, PartitionStrategy
from logweir.sources.log_store import (
    DEAD_LETTER,
    MALFORMED,
    layout_root,
    write_batch,
    write_dead_letters,
)
from logweir.sources.manifest import commit_batch, committed_rows
from logweir.sources.rollup import ROLLUP, write_rollup

TRIGGER = "1 minute"

# Datasets of a batch that are written at the same time.
MOST_WRITES = 4

# Set by Spark on the thread that runs a micro-batch. The id lives in the checkpoint, so a
# restart keeps it and a new checkpoint, whose batches count from 0 again, gets a new one.
_QUERY_ID = "sql.streaming.queryId"


def land_batch(
    messages: DataFrame,
    root: str,
    stream_id: str,
    batch_id: int,
    schemas: Mapping[str, StructType] | None = None,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    default: StructType = DEFAULT_PAYLOAD,
) -> dict[str, int]:
    """Write one batch, one job per layout that occurs in it; return the rows of each.

    Messages without a route are kept apart and counted under ``dead_letter``. A payload of
    which nothing could be parsed is landed as a row of nulls, kept apart as text with its
    route, and counted under ``malformed`` too. Rows per minute, level and origin are landed
    beside the logs.

    The batch becomes visible at the end, in all its datasets at once. One that has landed is
    not written again, so a replay changes nothing; what a failed try has left is not read and
    is overwritten by the next one. The batch is held in memory and on local disks meanwhile,
    so the source should bound it (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``).
    """
    spark = messages.sparkSession
    found = committed_rows(spark, root, stream_id, batch_id)
    if found is not None:
        return {name: count for name, count in found.items() if name != ROLLUP}
    schemas = registered_schemas() if schemas is None else schemas
    layout = F.when(is_routable(), strategy.layout_of_row())
    merged = merged_payload(schemas, default)
    rows = parse_payload(decode_envelope(messages), schemas, default).withColumns(
        {"_layout": layout, "_malformed": is_routable() & is_malformed(merged)}
    )
    # A payload that was parsed is held as its fields alone, not as text too.
    text = F.when(F.col("_malformed"), F.col("_message")).otherwise(F.col("_raw"))
    rows = rows.withColumn("_raw", text).drop("_message")
    # Every layout reads the batch; without this each would fetch it from the source again.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # A row per layout and day of the batch.
        day = F.to_date(F.col("data.time").cast("timestamp")).alias("day_")
        counted = rows.groupBy("_layout", day).agg(
            F.count(F.lit(1)).alias("count"), F.count_if("_malformed").alias("malformed")
        )
        facts: dict[str, dict[date | None, int]] = {}
        malformed = 0
        for r in counted.collect():
            by_day = facts.setdefault(r["_layout"] or DEAD_LETTER, {})
            by_day[r["day_"]] = by_day.get(r["day_"], 0) + r["count"]
            malformed += r["malformed"]
        writes = []
        for name, partition_by in strategy.layouts.items():
            if name in facts:
                logs = finish_logs(rows.filter(F.col("_layout") == name))
                place = layout_root(root, name)
                writes.append(partial(write_batch, logs, place, stream_id, batch_id, partition_by))
        if DEAD_LETTER in facts or malformed:
            dead = rows.filter(F.col("_layout").isNull() | F.col("_malformed")).select(
                "_raw", "_documentType", "_plugin"
            )
            writes.append(partial(write_dead_letters, dead, root, stream_id, batch_id))
        timed: dict[date | None, int] = {}
        for name in strategy.layouts:
            for day_, count in facts.get(name, {}).items():
                if day_ is not None:
                    timed[day_] = timed.get(day_, 0) + count
        if timed:
            logs = finish_logs(rows.filter(F.col("_layout").isNotNull()))
            writes.append(partial(write_rollup, logs, root, stream_id, batch_id))
        # The datasets do not depend on each other.
        with ThreadPoolExecutor(MOST_WRITES) as pool:
            run = inheritable_thread_target(spark)
            for done in [pool.submit(run(write)) for write in writes]:
                done.result()
    finally:
        rows.unpersist()
    if malformed:
        facts[MALFORMED] = {None: malformed}
    kept = {ROLLUP: timed} if timed else {}
    commit_batch(spark, root, stream_id, batch_id, facts | kept)
    return {name: sum(by_day.values()) for name, by_day in facts.items()}


def start_ingest(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    schemas: Mapping[str, StructType] | None = None,
    strategy: PartitionStrategy = STANDARD_STRATEGY,
    default: StructType = DEFAULT_PAYLOAD,
    available_now: bool = False,
    every: str = TRIGGER,
    on_landed: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Start the ingest of a stream with a ``value`` column; it resumes from ``checkpoint``.

    Batches run every minute, or until the source is drained with ``available_now``.
    ``on_landed`` is told the number of each batch and its rows per layout, those of the
    dead letters among them.
    """

    check_session(messages.sparkSession)

    def land(batch: DataFrame, batch_id: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID)
        if stream_id is None:
            raise ConfigurationError("the batch does not know which stream it belongs to")
        counts = land_batch(batch, root, stream_id, batch_id, schemas, strategy, default)
        if on_landed is not None:
            on_landed(batch_id, counts)

    writer = messages.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()
