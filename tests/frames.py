"""Small inputs shared by the tests."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from logweir.operators.parse import add_calendar
from logweir.schemas import DEFAULT_PAYLOAD


def epoch(*when):
    return int(datetime(*when, tzinfo=UTC).timestamp())


def log_rows(spark, rows):
    """Log-store rows from (time text or None, level, message)."""
    raw = spark.createDataFrame(rows, "time string, level string, message string")
    given = {"time": F.col("time").cast("timestamp")}
    fields = [
        given.get(f.name, F.col(f.name) if f.name in raw.columns else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in DEFAULT_PAYLOAD.fields
    ]
    typed = raw.select(F.struct(*fields).alias("data"))
    typed = typed.withColumns({"_documentType": F.lit("t"), "_plugin": F.lit("p")})
    return add_calendar(typed)


def values(df, *columns):
    rows = df.select(*(columns or "*")).collect()
    return [tuple(row) if len(row) > 1 else row[0] for row in rows]
