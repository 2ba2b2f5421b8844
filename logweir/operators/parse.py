"""From raw messages to typed log rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweir.schemas import DEFAULT_PAYLOAD, ENVELOPE, merged_payload

ORIGIN = ("_documentType", "_plugin")


def decode_envelope(messages: DataFrame) -> DataFrame:
    """Parse the ``value`` column and promote its fields; the payload becomes ``_message``.

    ``_raw`` keeps the text of rows without a document type or plugin, and only of those.
    """
    text = F.col("value").cast("string")
    opened = messages.select(F.from_json(text, ENVELOPE).alias("data"), text.alias("_text"))
    unroutable = F.col("data._documentType").isNull() | F.col("data._plugin").isNull()
    return opened.select(
        *[F.col(f"data.{name}").alias(name) for name in ORIGIN],
        F.col("data.message").alias("_message"),
        F.when(unroutable, F.col("_text")).alias("_raw"),
    )


def is_routable() -> Column:
    return F.col("_documentType").isNotNull() & F.col("_plugin").isNotNull()


def route_key() -> Column:
    """``documentType.plugin``, the key of the payload schemas."""
    return F.concat(F.col("_documentType"), F.lit("."), F.col("_plugin"))


def routing_keys(rows: DataFrame) -> DataFrame:
    """The distinct document types and plugins of a batch."""
    return rows.select(*ORIGIN).distinct()


def split_by_route(rows: DataFrame, keys: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of each key, and the rows of every other key."""
    branches = {key: rows.filter(route_key() == F.lit(key)) for key in keys}
    rest = rows.filter(is_routable())
    return branches, rest.filter(~route_key().isin(keys)) if keys else rest


def parse_payload(
    rows: DataFrame,
    schemas: Mapping[str, StructType],
    default: StructType = DEFAULT_PAYLOAD,
) -> DataFrame:
    """Add ``data``: ``_message`` parsed with the schema registered for the row's route.

    A row is parsed once, by its own schema. Fields that only other schemas have are null,
    so that all rows share one struct and a whole layout is written by one job.
    """
    merged = merged_payload(schemas, default)
    keys_of: list[tuple[StructType, list[str]]] = []
    for key, schema in schemas.items():
        if schema == default:
            continue
        group = next((keys for known, keys in keys_of if known == schema), None)
        if group is None:
            keys_of.append((schema, [key]))
        else:
            group.append(key)

    message = F.col("_message")
    if not keys_of:
        return rows.withColumn("data", F.from_json(message, default))

    special = [key for _, keys in keys_of for key in keys]
    route = route_key()
    parsed = {"_payload_default": F.when(~route.isin(special), F.from_json(message, default))}
    structs = {"_payload_default": default}
    for number, (schema, keys) in enumerate(keys_of):
        name = f"_payload_{number}"
        parsed[name] = F.when(route.isin(keys), F.from_json(message, schema))
        structs[name] = schema

    def widened(name: str) -> Column:
        own = set(structs[name].fieldNames())
        fields = [
            (F.col(f"{name}.{f.name}") if f.name in own else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in merged.fields
        ]
        return F.when(F.col(name).isNotNull(), F.struct(*fields))

    return (
        rows.withColumns(parsed)
        .withColumn("data", F.coalesce(*[widened(name) for name in parsed]))
        .drop(*parsed)
    )


def add_calendar(rows: DataFrame) -> DataFrame:
    """Event time of the payload and its calendar parts."""
    return rows.withColumn("_time", F.col("data.time").cast("timestamp")).withColumns(
        {
            "year": F.year("_time"),
            "month": F.month("_time"),
            "day": F.dayofmonth("_time"),
        }
    )


def settle_origin(rows: DataFrame) -> DataFrame:
    """Document type and plugin as the payload states them, else as the envelope does."""
    return rows.withColumns(
        {name: F.coalesce(F.col(f"data.{name}"), F.col(name)) for name in ORIGIN}
    )


def is_malformed(payload: StructType = DEFAULT_PAYLOAD) -> Column:
    """Whether a payload text is there but none of the fields of its schema is in it."""
    any_filled = reduce(
        Column.__or__, [F.col("data").getField(f.name).isNotNull() for f in payload.fields]
    )
    return F.col("_message").isNotNull() & ~any_filled


def finish_logs(parsed: DataFrame) -> DataFrame:
    """Rows of the log store from parsed payloads."""
    return settle_origin(add_calendar(parsed)).select(
        "data", "_time", *ORIGIN, "year", "month", "day"
    )


def typed_logs(
    rows: DataFrame,
    schemas: Mapping[str, StructType],
    default: StructType = DEFAULT_PAYLOAD,
) -> DataFrame:
    """Rows of the log store from decoded, routable envelopes."""
    return finish_logs(parse_payload(rows, schemas, default))
