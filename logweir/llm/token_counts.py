"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.pieces import encoder, windows

# Bytes of text encoded at once.
BATCH_BYTES = 5_000_000


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One row per row of ``docs``, of which only ``doc_id`` and ``text`` are read, so repeated
    rows are counted each and other columns may have any name. A null or empty text has no
    bytes and no tokens. ``vocabulary`` is a file of the ``tokenizers`` (``.json``) or
    ``sentencepiece`` (``.model``) library, present on every machine; strings of special
    tokens inside a text are handled as that library does by default.

    Batches hold about ``batch_bytes`` of text each. Longer texts are split where no token can
    cross (see ``logweir.llm.pieces``) and counted window by window, so one of any length takes
    its bytes and the work space of a window. Only a text without any such place, or with
    another vocabulary, goes to the library whole.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        earlier = 0
        for batch, text, ends in windows(batches, encode, batch_bytes):
            found = encode.counts(text) + earlier
            earlier = 0 if ends else int(found[0])
            if ends:
                size = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pc.fill_null(size, 0), pa.array(found, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(
        lengths, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
