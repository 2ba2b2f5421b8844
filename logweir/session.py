"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from logweir.errors import ConfigurationError

# Calendar columns, rendered times and day ranges are all taken in this zone.
TIME_ZONE = "UTC"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone of an existing session and return it."""
    spark.conf.set("spark.sql.session.timeZone", TIME_ZONE)
    return spark


def check_session(spark: SparkSession) -> None:
    """Raise unless the session has what jobs that write rely on (see :func:`prepare`)."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ConfigurationError(f"the session's time zone is {zone}, not {TIME_ZONE}")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        raise ConfigurationError("adaptive execution is off; it splits crowded partitions")


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logweir")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", TIME_ZONE)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
