"""One query per operator of this package, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logweir.llm.language_id import fit, predict
from logweir.llm.mixing import mix
from logweir.llm.nearest import nearest
from logweir.llm.ngram_join import ngram_classes
from logweir.llm.packing import pack
from logweir.llm.periodic_runs import periodic_runs, run_digests, with_planted_runs
from logweir.llm.quality_rules import quality
from logweir.llm.secret_scans import secrets
from logweir.llm.span_dedup import remove_repeats
from logweir.llm.spelling_variants import spelling_variants, word_counts
from logweir.llm.token_counts import token_counts
from logweir.llm.token_grammar import token_files
from logweir.llm.url_filters import parse_rule, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
# One run of letters in so many loses a letter, which gives the query variants to find.
DROP_EVERY = 199
URL_RULES = (
    "allow org/",
    "block example.org/es/",
    "block example.org/en/1",
    "allow com/fr/",
    "block com/de/",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("positions")


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, PIECE_VOCABULARY))


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), [parse_rule(r) for r in URL_RULES])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_table(spark, sf_dir, "documents"))
    return run_digests(periodic_runs(docs))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(_table(spark, sf_dir, "documents"), drop_every=DROP_EVERY)
    return spelling_variants(counts)


def llm_queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_packing,
            op2_token_counts,
            op3_ngram_join,
            op4_source_mix,
            op5_span_dedup,
            op6_language_id,
            op7_url_verdicts,
            op8_secret_scan,
            op9_quality_rules,
            op10_nearest,
            op11_token_files,
            op12_periodic_runs,
            op13_spelling_variants,
        )
    }
