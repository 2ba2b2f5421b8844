"""Token ids of many texts at once: each different piece of text is encoded only once.

A text is cut where no token of a byte-level vocabulary without normaliser can cross, so the
ids of the pieces, one after the other, are those of the text. Such places are

* before a blank that a plain letter, digit or sign follows: the pattern of these vocabularies
  leaves the last of several blanks to the word behind them;
* between a plain letter or digit and a blank, line end or common sign behind it: no alternative
  of the pattern goes on there, and no added token holds such a character;
* between a single line end and a plain letter or digit behind it.

Other vocabularies get whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenizers.pre_tokenizers import ByteLevel

from logweir.llm.words import SLICE_BYTES, kept, slices, text_bytes

# Pieces kept from batch to batch in a worker: of at most so many bytes each, and with their ids
# so many bytes in all. Others are encoded anew each time they come.
KEPT_PIECE, KEPT_BYTES = 48, 24_000_000
# Bytes of pieces handed to the library as one text.
JOINED_BYTES = 16_384

_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3] = True  # of the letters U+00C0 to U+00FF
_PLAIN = np.zeros(256, bool)
for _first, _last in ("09", "AZ", "az"):
    _PLAIN[ord(_first) : ord(_last) + 1] = True
# The second byte of a letter U+00C0 to U+00FF: all but the signs of times and division.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SIGNS = " \n.,;:!?\"'()-"


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable sign (fixed rule)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WholeTexts:
    """Any vocabulary file of the two libraries, text by text."""

    def __init__(self, path: str):
        self.model = path.endswith(".model")
        if self.model:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.library = _tokenizer(path)
        self.n_ids = self.library.get_piece_size() if self.model else self.library.get_vocab_size()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(column, "").to_pylist()
        if self.model:
            ids = self.library.encode(texts, num_threads=1)
        else:
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum()))
        return counts, flat

    def counts(self, column: pa.Array) -> np.ndarray:
        return self.encode(column)[0]

    def windows(self, text: pa.Array, limit: int) -> Iterator[pa.Array]:
        yield text

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As of ``Pieces``, each text being a piece."""
        counts, ids = self.encode(column)
        return np.arange(len(counts)), np.arange(len(counts) + 1), counts, ids


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class Pieces:
    """A byte-level vocabulary; keeps the ids of the first pieces it meets."""

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        signs = _byte_of_sign()
        known = self.library.get_added_tokens_decoder()
        added = {i: len(x.content.encode()) for i, x in known.items()}
        sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            sizes[i] = added.get(i, len(token) if set(token) <= signs.keys() else 0)
        self.sizes = sizes
        self.n_ids = len(sizes)
        inside = "".join(x.content for x in known.values())
        self.signs = np.zeros(256, bool)
        self.signs[[ord(c) for c in _SIGNS if c not in inside]] = True
        self.kept = pa.array([], pa.large_string())
        self.kept_counts = np.empty(0, np.int64)
        self.kept_ids = np.empty(0, np.int32)

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, many of them at once as one text."""
        begin, data = text_bytes(pieces)
        filled = begin[:-1] < begin[1:]
        at = begin[:-1][filled]
        opens = np.zeros(len(pieces), bool)
        after = np.minimum(at + 1, max(0, len(data) - 1))
        opens[filled] = (data[at] == 0x20) & (at + 1 < begin[1:][filled]) & _OPENS[data[after]]
        heads = ~opens | (np.diff(begin[:-1] // JOINED_BYTES, prepend=-1) > 0)
        cuts = np.append(begin[:-1][heads], len(data))
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        lengths = [len(x) for x in found]
        ids = np.fromiter((i for x in found for i in x.ids), np.int32, sum(lengths))
        ends = np.cumsum(self.sizes[ids])
        if len(ids) and ends[-1] != len(data):
            raise ValueError("token lengths do not add up to the text: not a byte-level vocabulary")
        counts = np.diff(np.searchsorted(ends, begin, "right"))
        return counts, ids

    def _different(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Count of ids by piece, and all ids, of pieces no two of which are equal."""
        place = places_in(self.kept, pieces)
        known = place >= 0
        fresh = pieces.filter(pa.array(~known))
        new_counts, new_ids = self._new(fresh)
        counts = np.empty(len(pieces), np.int64)
        counts[~known] = new_counts
        counts[known] = self.kept_counts[place[known]]
        old_first = np.cumsum(self.kept_counts) - self.kept_counts
        new_first = np.cumsum(new_counts) - new_counts + len(self.kept_ids)
        first = np.empty(len(pieces), np.int64)
        first[~known] = new_first
        first[known] = old_first[place[known]]
        ids = np.concatenate([self.kept_ids, new_ids])[runs(first, counts)]
        self._keep(fresh, new_counts, new_ids)
        return counts, ids

    def _keep(self, fresh: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Remember what is small, as far as there is room."""
        room = KEPT_BYTES - self.kept.nbytes - self.kept_counts.nbytes - self.kept_ids.nbytes
        if room <= 0 or not len(fresh):
            return
        size = pc.binary_length(fresh).to_numpy()
        takes = (size <= KEPT_PIECE) & (np.cumsum(size + 16 + 4 * counts) <= room)
        first = np.cumsum(counts) - counts
        self.kept = pa.concat_arrays([self.kept, fresh.filter(pa.array(takes))])
        self.kept_counts = np.concatenate([self.kept_counts, counts[takes]])
        self.kept_ids = np.concatenate([self.kept_ids, ids[runs(first[takes], counts[takes])]])

    def places(self, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where texts may be cut, beside their ends; ``begin`` as of ``text_bytes``."""
        if len(data) < 2:
            return np.empty(0, np.int64)
        plain = _PLAIN[data]
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1
        plain[wide[_LATIN[data[wide]]]] = True
        here = np.zeros(len(data), bool)
        here[1:] = plain[:-1] & self.signs[data[1:]]
        here[:-1] |= (data[:-1] == 0x20) & _OPENS[data[1:]]
        if self.signs[0x0A]:
            ends = np.flatnonzero(data[1:-1] == 0x0A) + 1
            single = plain[ends - 1] | self.signs[data[ends - 1]]
            single &= (data[ends - 1] != 0x20) & (data[ends - 1] != 0x0A)
            single &= _PLAIN[data[ends + 1]] | (data[ends + 1] == 0xC3)
            here[ends[single] + 1] = True
        here[begin[begin < len(data)]] = False
        return np.flatnonzero(here)

    def _cut(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        begin, data = text_bytes(column)
        cuts = np.sort(np.concatenate([begin, self.places(begin, data)]), kind="stable")
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(data)
        )
        return pieces.dictionary_encode(), np.searchsorted(cuts, begin)

    def windows(self, text: pa.Array, limit: int) -> Iterator[pa.Array]:
        """One text as several of about ``limit`` bytes, where it may be cut."""
        _, data = text_bytes(text)
        at = 0
        while at < len(data):
            to, size = len(data), limit
            while at + size < len(data):
                found = self.places(np.zeros(1, np.int64), data[at : at + size + 2])
                found = found[found < size]
                if len(found):
                    to = at + int(found[-1])
                    break
                size *= 2
            yield pa.array([data[at:to].tobytes().decode()], pa.large_string())
            at = to

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts as pieces: which piece comes at each place, the first place of each text (one
        more at the end), and the number of ids of each piece and the ids themselves."""
        coded, first = self._cut(column)
        counts, ids = self._different(coded.dictionary)
        return coded.indices.to_numpy(), first, counts, ids

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text; null is empty."""
        place, first, counts, _ = self.coded(column)
        ends = np.append(0, np.cumsum(counts[place]))
        return np.diff(ends[first])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in order."""
        place, first, counts, ids = self.coded(column)
        ends = np.append(0, np.cumsum(counts[place]))
        starts = np.cumsum(counts) - counts
        return np.diff(ends[first]), ids[runs(starts[place], counts[place])]


def places_in(kept: pa.Array, values: pa.Array) -> np.ndarray:
    """Place of each value among the kept ones, -1 if it is none of them; each has no equals.

    The kept ones are looked up among the values: the table Arrow builds anew for every lookup
    is one of the values of a batch, not of all that a worker keeps.
    """
    found = pc.fill_null(pc.index_in(kept, value_set=values), -1).to_numpy()
    place = np.full(len(values), -1, np.int64)
    at = np.flatnonzero(found >= 0)
    place[found[at]] = at
    return place


def runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... counts[0] numbers, then the same for the next."""
    total = int(counts.sum())
    jump = np.repeat(first - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + jump


def _cuts_at_blanks(path: str) -> bool:
    if path.endswith(".model"):
        return False
    library = _tokenizer(path)
    before = library.pre_tokenizer
    plain = all(
        not (x.lstrip or x.rstrip or x.single_word) and " " not in x.content
        for x in library.get_added_tokens_decoder().values()
    )
    return (
        plain
        and library.normalizer is None
        and type(before) is ByteLevel
        and before.use_regex
        and not before.add_prefix_space
    )


def encoder(path: str) -> Pieces | WholeTexts:
    """The encoder of a vocabulary file; a worker keeps the last one it used."""
    return kept(path, lambda: Pieces(path) if _cuts_at_blanks(path) else WholeTexts(path))


def windows(
    batches: Iterator[pa.RecordBatch], encode: Pieces | WholeTexts, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool]]:
    """Rows and their texts, about ``limit`` bytes at once, and whether their last text ends.

    A longer text comes alone, in as many windows as it takes; its ids are those of its windows
    one after the other.
    """
    for batch in slices(batches, limit=limit):
        text = batch.column("text")
        if batch.num_rows > 1 or (pc.binary_length(text)[0].as_py() or 0) <= limit:
            yield batch, text, True
            continue
        held = None
        for window in encode.windows(text, limit):
            if held is not None:
                yield batch, held, False
            held = window
        yield batch, held, True
