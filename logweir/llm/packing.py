"""Packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.packing_plan import HEAD, TAIL, UNIT, WHOLE, Plan, item_type, make_plan
from logweir.llm.pieces import encoder
from logweir.llm.tables import Scratch
from logweir.llm.words import slices

LENGTH = 2048
END_ID = 1
# Pieces of one class are numbered in groups of about so many, by a hash of their document.
GROUP_ROWS = 100_000

# Bytes of text encoded at once; the arrays beside them take some thirty times as much.
BATCH_BYTES = 1_000_000

PIECE = (
    "start long, length long, ids_crc32 long, doc_tokens long, head long, head_crc long, "
    "tail_crc long, units int"
)


def document_pieces(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """The ids of each document, closed by ``end_id``, cut every ``length``: checksums only.

    The last piece of a document also gets the checksums of its two parts, should it be cut at
    the largest power of two below its length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES):
            counts, ids = encoder(vocabulary).encode(batch.column("text"))
            ends = np.cumsum(counts)
            rows = []
            for k in range(batch.num_rows):
                own = ids[ends[k] - counts[k] : ends[k]]
                raw = memoryview(np.append(own, end_id).astype("<u4").tobytes())
                total = len(own) + 1
                for start in range(0, total, length):
                    size = min(length, total - start)
                    piece = raw[4 * start : 4 * (start + size)]
                    units = -(-size // UNIT)
                    head = UNIT << max(0, (units - 1).bit_length() - 1)
                    if size == length or head >= size:
                        head = 0
                    rows.append(
                        (
                            k,
                            start,
                            size,
                            zlib.crc32(piece),
                            total,
                            head,
                            zlib.crc32(piece[: 4 * head]) if head else 0,
                            zlib.crc32(piece[4 * head :]) if head else 0,
                            units,
                        )
                    )
            place, *columns = (np.array(c, np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(place)),
                    *(pa.array(c) for c in columns[:-1]),
                    pa.array(columns[-1].astype(np.int32)),
                ],
                names=["doc_id", *(x.split()[0] for x in PIECE.split(", "))],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {PIECE}")


class Slots:
    """Where the items of a plan go: arrays with an entry per pattern and item type."""

    def __init__(self, plan: Plan):
        rows, first, given = [], 0, {}
        for pattern in plan.patterns:
            for order, (item, times) in enumerate(pattern.items):
                rows.append((item, given.get(item, 0), first, times, order))
                given[item] = given.get(item, 0) + pattern.repeats * times
            first += pattern.repeats
        rows.sort()
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        self.item, self.rank, self.first, self.times, self.order = columns

    def place(self, item: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the rank-th piece of each item type."""
        big = np.int64(1) << np.int64(48)
        at = np.searchsorted(self.item * big + self.rank, item * big + rank, "right") - 1
        inside = rank - self.rank[at]
        sequence = self.first[at] + inside // self.times[at]
        return sequence, self.order[at] * (1 << 12) + inside % self.times[at]


def pack(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``length`` tokens.

    One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32`` (of its ids as unsigned
    little-endian 32-bit numbers), ``doc_tokens`` (with the closing id), ``sequence_id`` and
    ``offset``. Reads ``doc_id`` and ``text``. A null or empty text is the closing id alone;
    each of several equal rows is packed; no documents give no pieces.

    Documents are cut every ``length`` tokens; a full piece is a sequence. What remains of each
    is packed by a plan over the histogram of lengths in units of 8 tokens (see
    ``logweir.llm.packing_plan``), which may cut it once more. Pieces are numbered within
    their class by groups dealt by a hash of id, start and content, with running totals
    over the groups, so neither a class that holds most pieces nor rows without an id are a
    single task. Only the histogram reaches the driver.
    """
    scratch = Scratch("packing")
    pieces = scratch.write(document_pieces(docs, vocabulary, length, end_id))
    histogram = pieces.groupBy("units").agg(F.count("*").alias("n"))
    counted = {r["units"]: r["n"] for r in histogram.collect()}
    plan = make_plan(counted, -(-length // UNIT))
    groups = max(32, math.ceil(sum(counted.values()) / GROUP_ROWS))

    # The checksum tells rows without an id, or of one id, apart.
    dealt = pieces.withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")
    )
    sizes = dealt.groupBy("units", "group").agg(F.count("*").alias("n"))
    running = (
        Window.partitionBy("units").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base")
    bases = sizes.select("units", "group", base)
    inside = Window.partitionBy("units", "group").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(bases, ["units", "group"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("inside"))

    slots = Slots(plan)
    whole = np.zeros(-(-length // UNIT) + 1, np.int64)
    for units, count in {**counted, **plan.whole}.items():
        whole[units] = plan.whole.get(units, 0)
    whole[-1] = counted.get(len(whole) - 1, 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n).to_numpy() for n in batch.schema.names if n != "doc_id"}
            units, rank = column["units"].astype(np.int64), column["rank"]
            cut = rank >= whole[units]
            parts = []
            for form, rows in ((WHOLE, ~cut), (HEAD, cut), (TAIL, cut)):
                at = np.flatnonzero(rows)
                number = rank[at] - (0 if form == WHOLE else whole[units[at]])
                sequence, slot = slots.place(item_type(units[at], form), number)
                start, size, crc = (column[n][at] for n in ("start", "length", "ids_crc32"))
                head = column["head"][at]
                if form == HEAD:
                    size, crc = head, column["head_crc"][at]
                elif form == TAIL:
                    start, size, crc = start + head, size - head, column["tail_crc"][at]
                parts.append((at, start, size, crc, column["doc_tokens"][at], sequence, slot))
            at, *found = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), *map(pa.array, found)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "head", "head_crc", "tail_crc",
        "units", "rank",
    ).mapInArrow(
        assign,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, slot long",
    )
    in_order = Window.partitionBy("sequence_id").orderBy("slot")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset
    )
