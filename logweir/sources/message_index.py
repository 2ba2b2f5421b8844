"""Which files of a compacted dataset hold which three characters in a row of their messages.

A keyword search opens only files that hold every trigram of a text its pattern requires. The
index lies beside the compacted rows, one folder per compaction, and counts with them::

    trigrams/generation=<id>/*.orc    trigram, day, file (below the generation's folder)

It is ordered by trigram, so the statistics of its files let a search read a few row groups of
it, whatever the number of files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.patterns import required_texts
from logweir.operators.filters import days_of, keyword_pattern
from logweir.sources.storage import exists

WIDTH = 3
INDEX = "trigram string, day date, file string"

# Files are named to the reader up to this many; a keyword that more of them hold is common,
# and the scan reads them all.
LISTED_FILES = 10_000


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + WIDTH] for i in range(len(text) - WIDTH + 1)})


def needed_trigrams(
    keywords: Sequence[str] | str | None, literal: bool = False
) -> list[list[str]] | None:
    """Trigrams a matching message holds: all of one of the lists; ``None`` where none are known."""
    pattern = keyword_pattern(keywords)
    if not pattern:
        return None
    if literal:
        words = keywords.split("|") if isinstance(keywords, str) else list(keywords)
        texts = [[w] for w in words]
    else:
        texts = required_texts(pattern)
    if texts is None:
        return None
    found = [sorted({g for text in branch for g in trigrams(text)}) for branch in texts]
    return found if all(found) else None


def _index_path(target: str, generation: str) -> str:
    return f"{target}/trigrams/generation={generation}"


def write_index(rows: DataFrame, target: str, generation: str) -> None:
    """Index the messages of a compaction's stored ``rows``.

    A message gives each of its trigrams once and a task combines those of its files before the
    shuffle, which so carries no more than the index itself.
    """
    (
        index_rows(rows, generation)
        .repartitionByRange("trigram", "day", "file")
        .sortWithinPartitions("trigram", "day", "file")
        .write.orc(_index_path(target, generation))
    )


def index_rows(rows: DataFrame, generation: str) -> DataFrame:
    """Each trigram of the messages, once per day and file.

    Days and paths are taken before a message is split, and files named after rows are combined,
    so neither is worked out once per trigram.
    """
    grams = F.regexp_extract_all(F.col("message"), F.lit(f"(?s)(?=(.{{{WIDTH}}}))"), F.lit(1))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    name = F.substring_index(path, f"/generation={generation}/", -1)
    return (
        rows.select(
            F.make_date("year", "month", "day").alias("day"),
            F.col("_metadata.file_path").alias("path"),
            F.col("data.message").alias("message"),
        )
        .select("day", "path", F.explode(F.array_distinct(grams)).alias("trigram"))
        .distinct()
        .select("trigram", "day", name.alias("file"))
    )


def files_to_read(
    spark: SparkSession,
    target: str,
    generation: str,
    needed: list[list[str]],
    span: tuple[int, int] | None = None,
) -> list[str] | None:
    """Files of a compaction in which a message may match; ``None`` if it has to be read whole.

    That is the case where it has no index, as those written before there was one, and where
    more files than can be named hold what is needed.
    """
    path = _index_path(target, generation)
    if not exists(spark, f"{path}/_SUCCESS"):
        return None
    wanted = sorted({g for grams in needed for g in grams})
    rows = spark.read.schema(INDEX).orc(path).filter(F.col("trigram").isin(wanted))
    if span:
        first, last = days_of(*span)
        rows = rows.filter(F.col("day").between(F.lit(first), F.lit(last)))
    held = rows.groupBy("file").agg(F.collect_set("trigram").alias("held"))
    has_all = [
        F.size(F.array_intersect("held", F.array(*map(F.lit, grams)))) == len(grams)
        for grams in needed
    ]
    files = held.filter(reduce(or_, has_all)).select("file").limit(LISTED_FILES + 1).collect()
    if len(files) > LISTED_FILES:
        return None
    return sorted(r["file"] for r in files)
