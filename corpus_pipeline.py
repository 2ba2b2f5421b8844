"""The corpus pipeline: documents in, packed token sequences out.

Every stage works on all that the one before kept, and its result is written as Parquet and
read again, so a lost executor costs no more than the running stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.language_id import fit, recognised
from logweir.llm.mixing import mixed_documents
from logweir.llm.ngram_join import one_per_class
from logweir.llm.packing import pack
from logweir.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY
from logweir.llm.secret_scans import redact
from logweir.llm.tables import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Text handed to a Python worker at once: both sides hold a batch several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(stage: Stage) -> Stage:
    """``stage`` with text handed to Python workers in small batches.

    A stage's result is lazy and Spark reads the setting when it runs, which is after the stage
    has returned, so the setting stays in the session.
    """

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages their rows name; others are rejected."""
    return recognised(docs, fit(docs, PIECE_VOCABULARY))


@small_batches
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in 0.8 of their five-word shingles."""
    return one_per_class(docs, width=5, percent=80)


@small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    return mixed_documents(docs)


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs, BYTE_VOCABULARY)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("packing", packing),
]

# Language models, component labels and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
