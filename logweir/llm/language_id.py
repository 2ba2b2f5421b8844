"""Language identification by unigrams over pieces, summed over all segmentations.

A language gives every piece of a fixed public vocabulary a probability. The probability of a
word is the sum over all its cuts into pieces of their products, found by a forward pass; that
of a text is the product over its words. Each different word of a batch is scored once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweir.llm.pieces import places_in, runs
from logweir.llm.tables import Scratch, free_name
from logweir.llm.words import kept, slices, text_bytes

UNKNOWN = "und"
# About so many rows of each language are fitted on, chosen by a hash of their ids.
FIT_ROWS = 2_000
ROUNDS = 3
# Added to the expected count of each piece, as a share of the mean count.
SMOOTHING = 0.05
# Longer words are scored in runs of so many bytes.
LONGEST_WORD = 48
KEPT_WORDS = 150_000
BROADCAST_LANGUAGES = 10_000
# The pass over these many words of one length takes some hundred numbers for each.
WORDS_AT_ONCE = 5_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def held_out() -> F.Column:
    """Whether a row is kept from fitting: crc32 of its id, as text, is a multiple of 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


class Vocabulary:
    """Lower-case letter pieces of a sentencepiece model, and its 256 single bytes.

    The sign for the start of a word is written as a blank. Pieces are looked up by a rolling
    hash of their bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            word = piece.removeprefix("▁")
            if word and word.isalpha() and word == word.lower():
                found.add((" " if word != piece else "") + word)
        spelled = sorted({x.encode() for x in found} | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, spelled))
        self.powers = np.append(np.uint64(1), np.full(self.longest, _BASE)).cumprod(dtype=np.uint64)
        hashes = np.array([self._hash(x) for x in spelled], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces of the vocabulary have one hash")

    @staticmethod
    def _hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def __len__(self) -> int:
        return len(self.hashes)

    def cuts(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length, a row each: begin, end, rows that have a piece there, pieces."""
        count, length = words.shape
        for end in range(1, length + 1):
            value = np.zeros(count, np.uint64)
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                value += (words[:, begin] + np.uint64(1)) * self.powers[end - 1 - begin]
                place = np.searchsorted(self.hashes, value)
                place[place == len(self.hashes)] = 0
                rows = np.flatnonzero(self.hashes[place] == value)
                if len(rows):
                    yield begin, end, rows, place[rows]


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a vocabulary file; a worker keeps them while it uses nothing else."""
    return kept(("pieces", path), lambda: Vocabulary(path))


def _forward(pieces: Vocabulary, words: np.ndarray, chance: np.ndarray):
    """alpha[row, end, language] with the cuts it came from; scaled so as not to vanish."""
    found = list(pieces.cuts(words))
    alpha = np.zeros((len(words), words.shape[1] + 1, chance.shape[1]))
    alpha[:, 0] = 1
    for begin, end, rows, place in found:
        alpha[rows, end] += alpha[rows, begin] * chance[place]
    return alpha, found


def word_scores(pieces: Vocabulary, words: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Log probability of each word (of one length) in each language."""
    return np.log(_forward(pieces, words, chance)[0][:, -1])


def expected_counts(
    pieces: Vocabulary, words: np.ndarray, weights: np.ndarray, chance: np.ndarray
) -> np.ndarray:
    """How often each piece is used on average over all segmentations, by language.

    ``weights[row, language]`` is how often the word occurs in the language.
    """
    alpha, found = _forward(pieces, words, chance)
    beta = np.zeros_like(alpha)
    beta[:, -1] = 1
    for begin, end, rows, place in reversed(found):
        beta[rows, begin] += beta[rows, end] * chance[place]
    share = weights / alpha[:, -1]
    counts = np.zeros_like(chance)
    for begin, end, rows, place in found:
        np.add.at(counts, place, alpha[rows, begin] * chance[place] * beta[rows, end] * share[rows])
    return counts


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and bytes (a row each) of words of each length."""
    begin, data = text_bytes(words)
    length = np.diff(begin)
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        for k in range(0, len(rows), WORDS_AT_ONCE):
            some = rows[k : k + WORDS_AT_ONCE]
            yield some, data[begin[some][:, None] + np.arange(size)]


def letter_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of letters in lower case, each behind a blank, and where each text's begin.

    Longer words are cut into runs of at most LONGEST_WORD bytes.
    """
    begin, data = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    letter = _LETTER[data]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    closes = letter.copy()
    closes[:-1] &= ~letter[1:]
    inner = begin[(begin > 0) & (begin < len(data))]
    opens[inner] = letter[inner]
    closes[inner - 1] = letter[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    parts = -(-(end - start) // LONGEST_WORD)
    if len(parts) and parts.max() > 1:
        start = np.repeat(start, parts) + LONGEST_WORD * runs(np.zeros(len(parts), int), parts)
        end = np.minimum(start + LONGEST_WORD, np.repeat(end, parts))
    # Spell the words one after the other, each behind a blank of its own.
    length = end - start + 1
    first = np.append(0, np.cumsum(length))
    spelled = np.full(first[-1], 0x20, np.uint8)
    inside = np.ones(first[-1], bool)
    inside[first[:-1]] = False
    spelled[inside] = data[runs(start, end - start)]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(first), pa.py_buffer(spelled)]
    )
    return words.dictionary_encode(), np.searchsorted(start, begin)


class Model:
    """Languages and the chance of each piece in them; small, sent to every task."""

    def __init__(self, path: str, languages: list[str], chance: np.ndarray):
        self.path, self.languages, self.chance = path, languages, chance
        self.key = hashlib.sha256(chance.tobytes() + repr(languages).encode()).hexdigest()


class Scorer:
    """Scores of the words a worker has met, for one model."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Vocabulary(model.path)
        self.kept = pa.array([], pa.large_binary())
        self.scores = np.empty((0, len(model.languages)))

    def of_words(self, words: pa.Array) -> np.ndarray:
        place = places_in(self.kept, words)
        known = place >= 0
        fresh = words.filter(pa.array(~known))
        new = np.empty((len(fresh), len(self.model.languages)))
        for rows, spelled in _by_length(fresh):
            new[rows] = word_scores(self.pieces, spelled, self.model.chance)
        found = np.empty((len(words), len(self.model.languages)))
        found[~known] = new
        found[known] = self.scores[place[known]]
        room = KEPT_WORDS - len(self.kept)
        if room > 0 and len(fresh):
            self.kept = pa.concat_arrays([self.kept, fresh.slice(0, room)])
            self.scores = np.concatenate([self.scores, new[:room]])
        return found

    def of_texts(self, column: pa.Array) -> np.ndarray:
        coded, first = letter_words(column)
        scores = self.of_words(coded.dictionary)
        place = coded.indices.to_numpy()
        sums = np.empty((len(column), scores.shape[1]))
        for k in range(scores.shape[1]):
            sums[:, k] = np.diff(np.append(0, np.cumsum(scores[place, k]))[first])
        return sums


def scorer(model: Model) -> Scorer:
    """The scorer of a model; a worker keeps the last one it used."""
    return kept(("scorer", model.key), lambda: Scorer(model))


def fit(docs: DataFrame, path: str, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit piece chances per language by expectation maximisation.

    Uses rows with text and language that are not held out, about ``rows`` of each language:
    those whose hashed id lies under the share that bound has of the language's rows. Word
    counts per language are an aggregation; every round sums expected counts per piece and
    language over tasks, so the driver gets no more than languages times pieces numbers.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()
    )
    scratch = Scratch("language-words")
    sizes = scratch.write(usable.groupBy("lang").agg(F.count("*").alias("n")))
    # One row per language: small, and broadcast so that no text is dealt out by language.
    few = sizes.count() <= BROADCAST_LANGUAGES
    chosen = usable.join(F.broadcast(sizes) if few else sizes, "lang").where(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) * F.col("n")
        < F.lit(rows * 1_000_000)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coded, first = letter_words(batch.column("text"))
            table = pa.table(
                {
                    "lang": batch.column("lang").take(
                        pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
                    ),
                    "word": coded,
                }
            )
            plain = table["word"].cast(pa.large_binary()).cast(pa.binary())
            groups = table.set_column(1, "word", plain).group_by(["lang", "word"])
            counts = groups.aggregate([([], "count_all")])
            yield from counts.rename_columns(["lang", "word", "n"]).to_batches()

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, word binary, n long")
    words = scratch.write(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = vocabulary(path)
    chance = np.full((len(pieces), max(1, len(languages))), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        model = Model(path, languages, chance)

        def expect(batches: Iterator[pa.RecordBatch], model: Model = model):
            total = np.zeros_like(model.chance)
            for batch in batches:
                lang = pc.index_in(batch["lang"], pa.array(model.languages)).to_numpy()
                weights = np.zeros((batch.num_rows, len(model.languages)))
                weights[np.arange(batch.num_rows), lang] = batch["n"].to_numpy()
                for rows_, spelled in _by_length(batch["word"].cast(pa.large_binary())):
                    total += expected_counts(
                        vocabulary(model.path), spelled, weights[rows_], model.chance
                    )
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(lang), pa.array(total[piece, lang])],
                names=["piece", "lang", "n"],
            )

        sums = words.mapInArrow(expect, "piece long, lang long, n double")
        counts = np.zeros_like(chance)
        for r in sums.groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"], r["lang"]] = r["n"]
        counts += SMOOTHING * counts.mean(axis=0) + 1e-9
        chance = counts / counts.sum(axis=0)
    scratch.drop(words, sizes)
    return Model(path, languages, chance)


def annotate(docs: DataFrame, model: Model, label: str, share: str) -> DataFrame:
    """All columns of ``docs`` with the best language of ``text`` and its share, named so."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            worded = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            known = worded.to_numpy(zero_copy_only=False)
            names = np.full(batch.num_rows, UNKNOWN, object)
            best = np.zeros(batch.num_rows)
            if model.languages:
                sums = scorer(model).of_texts(text)
                ratio = np.exp(sums - sums.max(axis=1, keepdims=True))
                place = ratio.argmax(axis=1)
                names[known] = np.array(model.languages, object)[place[known]]
                best[known] = (1 / ratio.sum(axis=1))[known]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(best)],
                names=[*batch.schema.names, label, share],
            )

    schema = StructType([*docs.schema.fields]).add(label, "string").add(share, "double")
    return docs.mapInArrow(score, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each row of ``docs``.

    Only ``doc_id`` and ``text`` are read. The score is the share of the best language in the
    summed probabilities of all, 0 to 1; of equal ones the first by name wins. A null text,
    one without a letter, and every text if no language was learned are ``und`` with score 0.
    """
    scored = annotate(docs.select("doc_id", "text"), model, "lang_pred", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least this share."""
    label, share = free_name(docs, "language"), free_name(docs, "share")
    kept = annotate(docs, model, label, share)
    return kept.where((F.col(label) != UNKNOWN) & (F.col(share) >= least)).select(docs.columns)

