"""Periodic runs of words, found on run-length grammars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.pieces import runs as numbers
from logweir.llm.recompression import RunLengthGrammar
from logweir.llm.words import Words, is_blank, slices, text_bytes

# A run repeats at least so often, and has at least so many words.
TIMES, LEAST = 3, 24
# Candidates looked at together; beside the texts, this bounds the memory of a task.
CANDIDATES = 1_500_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _candidates(
    counts: np.ndarray, times: int, least: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place in it and period of all candidates.

    A run of period p holds max(least, times * p) - p places or more whose word comes again p
    words later. A grid of that step over each text meets one of them for every run; all the
    grids of a text of n words have n log n places or so.
    """
    long = np.flatnonzero(counts >= least)
    most = counts[long] // times
    text = np.repeat(long, most)
    period = numbers(np.ones(len(long), np.int64), most)
    step = np.maximum(least, times * period) - period
    size = -(-(counts[text] - period) // step)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + CANDIDATES, "right")))
        own = size[at:to]
        number = numbers(np.zeros(len(own), np.int64), own)
        place = number * np.repeat(step[at:to], own)
        yield np.repeat(text[at:to], own), place, np.repeat(period[at:to], own)
        at = to


def find_runs(
    symbols: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and smallest period of all runs, by text, start and period.

    ``symbols`` are the words of all texts by number, text t from ``first[t]`` on.
    """
    counts = np.diff(first)
    found = [np.empty((4, 0), np.int64)]
    grammar = None
    for text, place, period in _candidates(counts, times, least):
        here = first[text] + place
        same = np.flatnonzero(symbols[here] == symbols[here + period])
        if not len(same):
            continue
        if grammar is None:
            grammar = RunLengthGrammar(symbols, first[1:])
        text, place, period = text[same], place[same], period[same]
        here = here[same] + text + 1
        right = grammar.extension(here, here + period)
        left = grammar.extension(here - 1, here + period - 1, -1)
        length = left + period + right
        kept = length >= np.maximum(least, times * period)
        found.append(np.stack([text, place - left, length, period])[:, kept])
    every = np.concatenate(found, 1)
    # A stretch of a smaller period is met with its multiples too: the smallest is the period.
    every = every[:, np.lexsort((every[3], every[2], every[1], every[0]))]
    new = np.ones(every.shape[1], bool)
    new[1:] = (every[:3, 1:] != every[:3, :-1]).any(0)
    every = every[:, new]
    text, start, length, period = every[:, np.lexsort((every[3], every[1], every[0]))]
    return text, start, length, period


def _dropped(words: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether some run holds a word behind the run's first period."""
    edges = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edges, words.first[text] + start + period, 1)
    np.add.at(edges, words.first[text] + start + length, -1)
    return np.cumsum(edges)[:-1] > 0


def _joined(words: Words, begin: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, one blank between them."""
    text = np.repeat(np.arange(len(begin) - 1), words.count)[keep]
    start, end = words.start[keep], words.end[keep]
    followed = np.append(text[1:] == text[:-1], False) if len(text) else np.empty(0, bool)
    edges = np.zeros(len(words.data) + 2, np.int8)
    edges[start] += 1
    edges[end + followed] -= 1
    out = words.data[np.cumsum(edges[: len(words.data)], dtype=np.int8).view(bool)]
    out[is_blank(out)] = 0x20
    sizes = np.bincount(text, end - start + followed, len(begin) - 1).astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    return pa.LargeStringArray.from_buffers(
        len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))
    )


def _numbered(words: Words) -> np.ndarray:
    """Each word's number; equal words, and only these, have the same."""
    length = words.end - words.start
    offsets = np.append(0, np.cumsum(length))
    inside = words.data[~is_blank(words.data)]
    spelled = pa.LargeStringArray.from_buffers(
        len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inside))
    )
    return spelled.dictionary_encode().indices.to_numpy()


def _highest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of greatest length / period, then smallest start, then smallest period."""
    best = 0
    for k in range(1, len(start)):
        if int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """Maximal periodic stretches of words in each text.

    A run is a stretch of words with smallest period q, at least ``times`` * q and ``least`` words
    long, that neither neighbouring word extends. Returned per row of ``docs``: ``doc_id``,
    ``n_runs``, ``runs`` (array of start, length, period in words, by start, then period),
    ``start``, ``length``, ``period`` and ``exponent_milli`` of the run of greatest length /
    period (ties: smallest start, then period; null without runs), and ``collapsed``: the words no
    run holds behind its first period, joined by one blank.

    Reads ``doc_id`` and ``text``. Null, empty and blank texts have no words and no runs, and
    collapse to the empty text; repeated rows are handled each; no rows give none. Texts are
    worked on in batches of about 2 MB; a longer one comes alone and takes some 100 bytes a word.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            begin, data = text_bytes(batch.column("text"))
            words = Words(begin, data)
            text, start, length, period = find_runs(_numbered(words), words.first, times, least)
            keep = ~_dropped(words, text, start, length, period)
            edge = np.searchsorted(text, np.arange(batch.num_rows + 1))
            best = np.full(batch.num_rows, -1, np.int64)
            for t in np.flatnonzero(np.diff(edge)):
                own = slice(edge[t], edge[t + 1])
                best[t] = edge[t] + _highest(start[own], length[own], period[own])
            none = best < 0
            top = [np.append(x, 0)[best] for x in (start, length, period)]
            milli = 1000 * top[1] // np.maximum(top[2], 1)
            listed = pa.StructArray.from_arrays(
                [pa.array(x) for x in (start, length, period)], fields=list(_RUN)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(edge)),
                    pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), listed),
                    *(pa.array(x, mask=none) for x in (*top, milli)),
                    _joined(words, begin, keep).cast(pa.string()),
                ],
                names=[
                    "doc_id", "n_runs", "runs", "start", "length", "period", "exponent_milli",
                    "collapsed",
                ],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        find,
        f"doc_id {kind}, n_runs long, "
        "runs array<struct<start: long, length: long, period: long>>, "
        "start long, length long, period long, exponent_milli long, collapsed string",
    )


def _text_of_words(words: Column, at: Column, period: Column) -> Column:
    """Words, those from ``at`` on being the first ``period`` of them again and again."""
    again = F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.get(words, F.when(i < at, i).otherwise(at + (i - at) % period)),
    )
    return F.array_join(again, " ")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one text in ten repeats some of its words to its end.

    Which texts, from which word on and with which period follows from the checksum of the
    decimal ``doc_id``; a text without id or words stays as it is.
    """
    rows = docs.select("doc_id", "text")
    code = F.crc32(F.col("doc_id").cast("string"))
    rest = F.floor(F.col("_code") / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = F.col("_code") % 10 == 0
    coded = rows.withColumn("_code", code).withColumn("_words", F.when(chosen, words))
    count = F.size("_words")
    at = (rest % count).cast("int")
    period = (F.lit(1) + F.floor((count - at) / (F.lit(3) + rest % 8))).cast("int")
    planted = _text_of_words(F.col("_words"), at, period)
    return coded.select(
        "doc_id", F.when(chosen & (count > 0), planted).otherwise(F.col("text")).alias("text")
    )


def run_digests(runs: DataFrame) -> DataFrame:
    """Lists and texts of ``periodic_runs`` as SHA-256."""
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    )
    return runs.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
