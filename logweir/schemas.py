"""Row types of envelopes, payloads, saved searches, jobs and result metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from logweir.errors import ValidationError


def _fields(*names: str) -> StructType:
    return StructType(
        [StructField(n, TimestampType() if n == "time" else StringType()) for n in names]
    )


# The field names of the log messages.
ENVELOPE = _fields("_documentType", "_plugin", "message")
DEFAULT_PAYLOAD = _fields(
    "node",
    "_documentType",
    "_plugin",
    "pid",
    "host",
    "level",
    "ident",
    "time",
    "_tag_appName",
    "message",
)
SYSLOG_LINUX_PAYLOAD = DEFAULT_PAYLOAD
YARN_PAYLOAD = _fields(
    "node",
    "_documentType",
    "_plugin",
    "level",
    "time",
    "_tag_appName",
    "message",
    "yarnApplication",
    "yarnContainer",
)

# Saved searches and jobs as the transactional store exports them: nested values are JSON text.
# Fixed: the columns of its tables.
RAW_SIGNATURE = StructType(
    [
        StructField("signatureId", StringType()),
        StructField("plugin", StringType()),
        StructField("logLevel", StringType()),
        StructField("docType", StringType()),
        StructField("keywords", StringType()),
        StructField("createdTime", TimestampType()),
        StructField("lastModifiedTime", TimestampType()),
    ]
)
RAW_JOB = StructType(
    [
        StructField("jobId", StringType()),
        StructField("jobName", StringType()),
        StructField("logQueryProgress", StringType()),
        StructField("histogramProgress", StringType()),
        StructField("createdTime", TimestampType()),
        StructField("lastModifiedTime", TimestampType()),
        StructField("jobData", StringType()),
        StructField("tagAppName", StringType()),
        StructField("logQueryStatistics", StringType()),
        StructField("histogramStatistics", StringType()),
    ]
)
KEYWORDS = ArrayType(StringType())
PROGRESS = StructType([StructField("percentage", LongType())])
STATISTICS = StructType([StructField("totalRowCount", LongType())])
JOB_DETAILS = StructType(
    [
        StructField("signatureId", StringType()),
        StructField("startTime", LongType()),
        StructField("endTime", LongType()),
        StructField("histogramWindow", StringType()),
    ]
)

# One row per part of a stored result. Epoch seconds and counts are longs.
PART_METADATA = StructType(
    [
        StructField("partName", StringType()),
        StructField("part_id", LongType()),
        StructField("count", LongType()),
        StructField("startTimestamp", LongType()),
        StructField("endTimestamp", LongType()),
    ]
)
# The same with offsets in place of counts. ``whole``: every row of the part has a time.
PART_INDEX = StructType(
    [
        StructField("partName", StringType()),
        StructField("part_id", LongType()),
        StructField("startTimestamp", LongType()),
        StructField("endTimestamp", LongType()),
        StructField("whole", BooleanType()),
        StructField("endOffset", LongType()),
        StructField("startOffset", LongType()),
    ]
)
# One row that makes an attempt the result; ``schema`` is its row type as JSON.
RESULT_COMMIT = StructType(
    [
        StructField("attempt", StringType()),
        StructField("value", LongType()),
        StructField("schema", StringType()),
    ]
)
CHUNK_INDEX = StructType(
    [
        StructField("partName", StringType()),
        StructField("chunk_id", LongType()),
        StructField("startOffset", LongType()),
        StructField("endOffset", LongType()),
    ]
)


def registered_schemas(yarn_key: str | None = None) -> dict[str, StructType]:
    """Payload schema per ``documentType.plugin``; other keys use :data:`DEFAULT_PAYLOAD`.

    The yarn schema has no key of its own; pass one to have it used.
    """
    schemas = {"syslog.linux": SYSLOG_LINUX_PAYLOAD}
    if yarn_key is not None:
        schemas[yarn_key] = YARN_PAYLOAD
    return schemas


def merged_payload(
    schemas: Mapping[str, StructType], default: StructType = DEFAULT_PAYLOAD
) -> StructType:
    """One struct holding every field of the default and the registered schemas."""
    return _merge([default, *schemas.values()])


def _merge(schemas: Iterable[StructType]) -> StructType:
    merged: dict[str, StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            known = merged.setdefault(field.name, StructField(field.name, field.dataType))
            if known.dataType != field.dataType:
                raise ValidationError(
                    f"field {field.name!r} is registered both as "
                    f"{known.dataType.simpleString()} and {field.dataType.simpleString()}"
                )
    return StructType(list(merged.values()))
