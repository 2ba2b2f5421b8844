"""Spelling variants: words one edit apart, found through filters of the vocabulary."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.checksums import shifted
from logweir.llm.edit_filters import (
    ROOM,
    LengthFilter,
    blocks_for,
    by_length,
    hashes,
    letters,
    marks,
    probed_edits,
    spelled,
    turn_of,
)
from logweir.llm.tables import Scratch
from logweir.llm.words import LOWER, Words, slices, text_bytes

# Words: fewest code points, fewest occurrences; a form is so many times as frequent.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
# Bytes of filter broadcast at once; a vocabulary that needs more is probed in several turns.
FILTER_BYTES = 32_000_000
# Words of the vocabulary probed by one task.
TASK_WORDS = 50_000
# Bytes of text whose words are counted together.
BATCH_BYTES = 4_000_000

# Lengths of runs, in bytes, whose checksums are tabulated for every document.
_TABULATED = 48

_LETTER = np.zeros(256, bool)
for _first, _last in ("AZ", "az"):
    _LETTER[ord(_first) : ord(_last) + 1] = True


def _letter_runs(begin: np.ndarray, data: np.ndarray) -> Words:
    """Longest runs of A-Z, a-z and U+00C0 to U+00FF, lower-case A-Z."""
    inside = _LETTER[data]
    # 0xC3 begins each code point from U+00C0 to U+00FF, and no other.
    wide = data == 0xC3
    inside |= wide
    inside[1:] |= wide[:-1]
    return Words(begin, LOWER[data], inside)


def _checksums(ids: list, document: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What ``<doc_id>:`` adds to the checksum of a run behind it, for each run."""
    heads = [b":" if i is None else f"{i}:".encode() for i in ids]
    head = np.array([zlib.crc32(h) for h in heads], np.uint32)
    most = min(int(length.max(initial=0)), _TABULATED)
    table = np.stack([shifted(head, np.full(len(head), k)) for k in range(most + 1)], 1)
    found = table[document, np.minimum(length, most)]
    long = np.flatnonzero(length > most)
    found[long] = shifted(head[document[long]], length[long])
    return found


def word_counts(
    docs: DataFrame, fewest_letters: int = LETTERS, drop_every: int | None = None
) -> DataFrame:
    """``word`` and ``n``: how often each run of letters comes in all texts.

    A run is a longest one of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z is lower-cased;
    those of at least ``fewest_letters`` code points count. With ``drop_every``, a run loses one
    code point where that number divides the checksum of ``<doc_id>:<run>``: the one whose place
    is the checksum modulo the length.

    Reads ``text``, and ``doc_id`` for ``drop_every`` (null: nothing before the colon). Null and
    empty texts have no runs; repeated rows count each. Counts leave a task once per word and
    batch, so a word that is everywhere is no large group.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES):
            begin, data = text_bytes(batch.column("text"))
            runs = _letter_runs(begin, data)
            length = runs.end - runs.start
            offsets = np.append(0, np.cumsum(length))
            if not offsets[-1]:
                continue
            inside = np.zeros(len(runs.data) + 1, np.int8)
            inside[runs.start] += 1
            inside[runs.end] -= 1
            raw = runs.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
            coded = pa.LargeStringArray.from_buffers(
                len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))
            ).dictionary_encode()
            word, place = coded.dictionary, coded.indices.to_numpy()
            dropped: Counter = Counter()
            if drop_every:
                own = np.array([zlib.crc32(w.as_buffer()) for w in word], np.uint32)
                document = np.repeat(np.arange(batch.num_rows), runs.count)
                ids = batch.column("doc_id").to_pylist()
                code = _checksums(ids, document, length) ^ own[place]
                hit = code % np.uint32(drop_every) == 0
                for k in np.flatnonzero(hit):
                    text = word[place[k]].as_py()
                    at = int(code[k]) % len(text)
                    dropped[text[:at] + text[at + 1 :]] += 1
                place = place[~hit]
            times = np.bincount(place, minlength=len(word))
            first, _ = letters(word)
            kept = (np.diff(first) >= fewest_letters) & (times > 0)
            more = {w: n for w, n in dropped.items() if len(w) >= fewest_letters}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(
                        [word.filter(pa.array(kept)), pa.array(list(more), pa.large_string())]
                    ).cast(pa.string()),
                    pa.array(np.append(times[kept], list(more.values())).astype(np.int64)),
                ],
                names=["word", "n"],
            )

    columns = ["doc_id", "text"] if drop_every else ["text"]
    counted = docs.select(*columns).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _filters(words: DataFrame, blocks: dict[int, int], turn: int, turns: int) -> tuple[dict, np.ndarray]:
    """Filters of the words of one turn, by length, and the letters of all words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(256, bool)
            for _, table in by_length(batch.column("word")):
                sums = hashes(table)
                size = table.shape[1]
                block, bits = marks(sums[turn_of(sums, turns) == turn], blocks[size])
                seen[table] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(block), size, np.int32)),
                        pa.array(block.astype(np.int64)),
                        pa.array(bits.view(np.int64)),
                    ],
                    names=["size", "block", "bits"],
                )
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(used), np.int32)),
                    pa.array(used),
                    pa.array(np.ones(len(used), np.int64)),
                ],
                names=["size", "block", "bits"],
            )

    found = (
        words.select("word")
        .mapInArrow(mark, "size int, block long, bits long")
        .groupBy("size", "block")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    size, block, bits = (found.column(n).to_numpy() for n in ("size", "block", "bits"))
    filters = {}
    for length in np.unique(size[size > 0]):
        own = size == length
        array = np.zeros(blocks[int(length)], np.uint64)
        array[block[own]] = bits[own].view(np.uint64)
        filters[int(length)] = LengthFilter(array)
    return filters, np.sort(block[size == 0]).astype(np.uint8)


def near_words(words: DataFrame, scratch: Scratch, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n``: every two words one edit apart, both ways.

    ``words`` has each ``word`` once, with its ``n``. The edits of a word are looked up in
    broadcast filters; only those found are shuffled, to a join with the words themselves, which
    removes what a filter holds by mistake. Filters take at most about ``filter_bytes`` at once,
    so a larger vocabulary has several, by a hash of the word, probed in turn.
    """
    spark = words.sparkSession
    # Code points by word: at most as many rows as there are lengths.
    lengths = {
        r["size"]: r["n"]
        for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()
    }
    total = sum(lengths.values())
    turns = max(1, math.ceil(total * ROOM / 8 / filter_bytes))
    blocks = {size: blocks_for(-(-n // turns)) for size, n in lengths.items()}
    spread = words.repartition(max(1, -(-total // TASK_WORDS)))
    found = []
    for turn in range(turns):
        filters, alphabet = _filters(words, blocks, turn, turns)
        shared = spark.sparkContext.broadcast((filters, alphabet))
        found.append(scratch.write(_probed(spread, shared, turn, turns)))
        shared.unpersist()
    edits = found[0]
    for more in found[1:]:
        edits = edits.unionByName(more)
    real = edits.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.explode(
        F.array(
            F.struct("word", "n", "other", "other_n"),
            F.struct(
                F.col("other").alias("word"),
                F.col("other_n").alias("n"),
                F.col("word").alias("other"),
                F.col("n").alias("other_n"),
            ),
        )
    )
    return real.select(both.alias("pair")).select("pair.*")


def _probed(words: DataFrame, shared, turn: int, turns: int) -> DataFrame:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, alphabet = shared.value
        for batch in batches:
            for rows, table in by_length(batch.column("word")):
                for word, edited in probed_edits(table, filters, alphabet, turn, turns):
                    if len(word):
                        at = pa.array(rows[word])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("word").take(at),
                                batch.column("n").take(at),
                                spelled(edited).cast(pa.string()),
                            ],
                            names=["word", "n", "other"],
                        )

    return words.select("word", "n").mapInArrow(probe, "word string, n long, other string")


def _roots(forms: DataFrame, most: int, times: int, scratch: Scratch) -> DataFrame:
    """``word`` and ``root``: the last of the forms that follow from each word that has one.

    A form is ``times`` as frequent as its word, so a chain is short whatever the data: each
    round joins what is known with itself and doubles the steps.
    """
    hops = max(1, math.ceil(math.log(max(most, times), times)))
    known = scratch.write(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(hops))):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = scratch.write(
            known.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root")
            )
        )
    return known


def spelling_variants(
    counts: DataFrame,
    fewest: int = OCCURRENCES,
    times: int = TIMES,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Each word that comes at least ``fewest`` times, and the word it is a variant of.

    ``counts`` is the ``word`` and ``n`` of ``word_counts``. Two words are near if one inserted,
    deleted or replaced code point makes one the other. Returned per word: ``form`` (its near word
    of largest n, ties: smallest in code-point order, if that is at least ``times`` its own n),
    ``root`` (from the word, form after form to the last; the word itself if it has none), ``n``,
    ``n_near`` (its near words) and ``form_n``. No words give no rows.
    """
    scratch = Scratch("variants")
    words = scratch.write(counts.filter(F.col("n") >= fewest).select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    near = near_words(words, scratch, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), best.alias("best")
    )
    form_n = -F.col("best.n")
    chosen = form_n >= times * F.col("n")
    formed = scratch.write(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.form")).alias("form"),
            F.when(chosen, form_n).alias("form_n"),
        )
    )
    most = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(formed.filter("form is not null"), most, times, scratch)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
