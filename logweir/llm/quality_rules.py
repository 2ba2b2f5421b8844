"""Quality rules as a ledger: every rule is evaluated once, policies only read its bits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.words import (
    _BLANK,
    Words,
    mix64,
    segment_hashes,
    slices,
    text_bytes,
    window_hashes,
)

WINDOW_WORDS = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

# Failure conditions on the measures. The place of a rule is its bit: append, never reorder.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
# Which rules a version of the policy applies.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
}


def _by_text(first: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sum of marks between neighbouring entries of ``first``."""
    return np.diff(np.append(0, np.cumsum(marks, dtype=np.int64))[first])


def _measure(column: pa.Array) -> list[np.ndarray]:
    begin, data = text_bytes(column)
    words = Words(begin, data)
    inside = ~_BLANK[data]
    chars = inside & ((data & 0xC0) != 0x80)
    texts = len(column)

    ends = np.append(np.flatnonzero(data == 0x0A), begin[1:])
    ends.sort(kind="stable")
    starts = np.append(np.flatnonzero(data == 0x0A) + 1, begin[:-1])
    starts.sort(kind="stable")
    # A line break ends one line and opens another, so both lists pair up text by text.
    seen = np.append(0, np.cumsum(inside))
    filled = seen[ends] > seen[starts]
    starts, ends = starts[filled], ends[filled]
    of_line = np.searchsorted(begin, starts, "right") - 1
    keys = segment_hashes(data, starts, ends) ^ mix64(of_line.astype(np.uint64) + np.uint64(1))
    _, earliest = np.unique(keys, return_index=True)
    lines = np.bincount(of_line, minlength=texts)
    repeated = lines - np.bincount(of_line[earliest], minlength=texts)

    covered = np.zeros(len(words.start) + 1, np.int64)
    windows = window_hashes(words.hashes(), WINDOW_WORDS)
    if len(windows):
        of_word = np.repeat(np.arange(texts), words.count)
        whole = of_word[: len(windows)] == of_word[WINDOW_WORDS - 1 :]
        at = np.flatnonzero(whole)
        keys = windows[at] ^ mix64(of_word[at].astype(np.uint64) + np.uint64(1))
        _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[times[place] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW_WORDS, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    return [
        words.count,
        _by_text(begin, chars),
        _by_text(begin, _SYMBOL[data]),
        repeated,
        _by_text(words.first, repeat),
        lines,
    ]


def _bits(names: Sequence[str]) -> int:
    places = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures and ``failures``, a long with bit k set where rule k fails.

    One row per row of ``docs``, of which only ``doc_id`` and ``text`` are read. A null or
    empty text has no words. Lines are split at ``\\n``; those without a word are not counted.
    ``n_repeat_words`` counts the words inside five-word windows found twice or more in the
    text, ``n_dup_lines`` the lines equal to an earlier one. Equality of lines and windows is
    that of 64-bit hashes.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [pa.array(x, pa.int64()) for x in _measure(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *found], names=["doc_id", *MEASURES]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} long" for name in MEASURES)
    measured = docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, {columns}")
    bits: Column = F.lit(0).cast("long")
    for k, (_, failing) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << k)).otherwise(0).cast("long"))
    return measured.withColumn("failures", bits)


def fails(policy: str) -> Column:
    """Whether a row of the ledger fails any rule of a policy."""
    return F.col("failures").bitwiseAND(F.lit(_bits(POLICIES[policy])).cast("long")) != 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """``rule``, rows that fail it, and rows that only it removes, for the rules of a policy.

    Rows are first counted per set of failed rules, of which there are no more than
    2 ** len(RULES); every figure is a sum over those counts.
    """
    mask = _bits(POLICIES[policy])
    sets = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
    counted = sets.agg(F.count("*").alias("rows"))
    bit = {name: _bits([name]) for name in POLICIES[policy]}
    rules = [
        F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit"))
        for n, b in bit.items()
    ]
    named = F.explode(F.array(*rules))
    each = counted.select("bits", "rows", named.alias("r")).select("bits", "rows", "r.*")

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("rows")).otherwise(0))

    return each.groupBy("rule").agg(
        rows_where(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        rows_where(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
    )


def quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: no rule of the policy or the base fails."""
    rows = ledger(docs)
    return rows.withColumns(
        {"base_failed": fails("base"), "kept": ~(fails("base") | fails(policy))}
    )
