"""Sets of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from logweir.llm.words import LOWER, Words, mix64, text_bytes, window_hashes


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, A-Z in lower case.

    A text of fewer than ``width`` words has its whole sequence as one shingle; one without
    words, or null, has none.
    """
    begin, data = text_bytes(column)
    words = Words(begin, LOWER[data])
    hashes = words.hashes()
    windows = window_hashes(hashes, width)
    sets = []
    for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - first >= width:
            sets.append(np.unique(windows[first : end - width + 1]))
        elif end > first:
            count = end - first
            sets.append(mix64(window_hashes(hashes[first:end], count) + np.uint64(count)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
