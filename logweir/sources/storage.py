"""Paths in the shared file system and tables staged there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from logweir.errors import ConfigurationError

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_scratch() -> str:
    path = tempfile.mkdtemp(prefix="logweir-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a single machine."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_scratch()
    raise ConfigurationError(f"set {CHECKPOINT_DIR} to a folder all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    file_system, hadoop_path = _file_system(spark, path)
    return file_system.exists(hadoop_path)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears as a whole; false if there is one already."""
    file_system, target = _file_system(spark, path)
    if file_system.exists(target):
        return False
    # Readers pass over hidden files.
    _, hidden = _file_system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = file_system.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return file_system.rename(hidden, target)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    file_system, hadoop_path = _file_system(spark, path)
    stream = file_system.open(hadoop_path)
    try:
        size = file_system.getFileStatus(hadoop_path).getLen()
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def read_if_any(reader: DataFrameReader, kind: str, pattern: str) -> DataFrame | None:
    """What a path with wildcards matches, or ``None`` where that is nothing."""
    try:
        return reader.format(kind).load(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def footers(spark: SparkSession) -> SparkSession:
    """A session whose counts, minima and maxima over ORC files come from their footers.

    Grouped by partition columns too; no row is read for them. The caller's session keeps its
    settings.
    """
    session = spark.newSession()
    sources = session.conf.get("spark.sql.sources.useV1SourceList").split(",")
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in sources if s != "orc"))
    session.conf.set("spark.sql.orc.aggregatePushdown", "true")
    return session


def count_stored(df: DataFrame) -> int:
    """Rows of a table read from the ORC files of one folder, without reading them."""
    files = df.inputFiles()
    if not files:
        return 0
    folder = files[0].rsplit("/", 1)[0]
    return footers(df.sparkSession).read.schema(df.schema).orc(folder).count()


def discard(spark: SparkSession, path: str) -> None:
    file_system, hadoop_path = _file_system(spark, path)
    file_system.delete(hadoop_path, True)


@contextmanager
def staged(df: DataFrame, label: str = "staged") -> Iterator[DataFrame]:
    """Write ``df`` once and read it back from there, for jobs that need it several times.

    Cuts the lineage at files in the shared folder, so a lost executor costs a re-read of
    its splits and the source scan with its filters is never repeated.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    try:
        df.write.orc(path)
        yield spark.read.schema(df.schema).orc(path)
    finally:
        discard(spark, path)


@contextmanager
def staged_by(
    df: DataFrame, column: str, label: str = "staged"
) -> Iterator[Callable[[int], DataFrame]]:
    """Like :func:`staged`, with a folder per number in ``column``, each read alone."""
    spark = df.sparkSession
    path = new_path(spark, label)
    rest = df.drop(column).schema

    def rows_of(number: int) -> DataFrame:
        rows = read_if_any(spark.read.schema(rest), "orc", f"{path}/{column}={number}")
        return spark.createDataFrame([], rest) if rows is None else rows

    try:
        df.write.partitionBy(column).orc(path)
        yield rows_of
    finally:
        discard(spark, path)
