"""Token ids of a corpus in files of grammar-compressed shards.

A file is a Parquet table, so that Spark writes it as a whole or not at all. It has a row per
shard, in the order of documents::

    part, shard        which task wrote it, and its number there
    before, n_ids      ids of the part before the shard, and in it
    first_doc          number in the part of the document its first piece belongs to
    first_start        ids of that document in earlier shards
    closed             whether its last piece ends a document
    doc_ids, lengths   of each piece of a document: whose it is, how many ids
    symbol_counts      and how many symbols
    base               the first symbol that is not an id
    rules, sizes       of each further symbol: the two it stands for, how many ids they become
    symbols            the text of the shard

``rules``, ``sizes`` and ``symbols`` are little-endian unsigned 32-bit numbers. A document
longer than a shard has pieces in several.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.checksums import joined
from logweir.llm.pair_grammar import Grammar, compress
from logweir.llm.pieces import Pieces, WholeTexts, encoder, windows
from logweir.llm.tables import Scratch
from logweir.llm.words import give_back
from logweir.sources.storage import new_path

END_ID = 0
# Bytes of text compressed together, and written by one task.
SHARD_BYTES = 5_000_000
PART_BYTES = 32_000_000
MOST_PARTS = 50_000
# Spans decoded for one shard by one row of work.
SPANS_TOGETHER = 4096

_SHARD = (
    "part int, shard int, before long, n_ids long, first_doc long, first_start long, "
    "closed boolean, doc_ids array<{kind}>, lengths array<long>, symbol_counts array<int>, "
    "base int, rules binary, sizes binary, symbols binary"
)


class _Shards:
    """Makes the shards of a part, one after the other."""

    def __init__(self, encode: Pieces | WholeTexts, end_id: int, schema: pa.Schema):
        self.encode, self.end_id, self.schema = encode, end_id, schema
        self.part = TaskContext.get().partitionId()
        self.shard = self.before = self.first_doc = self.first_start = 0

    def row(self, doc_ids: pa.Array, text: pa.Array, closed: bool) -> pa.RecordBatch:
        place, first, counts, ids = self.encode.coded(text)
        # The closing id is a piece of its own.
        closing = first[1:] if closed else first[1:-1]
        place = np.insert(place, closing, len(counts))
        first = first + np.arange(len(first)) - np.append(np.zeros(len(first) - 1, int), not closed)
        counts, ids = np.append(counts, 1), np.append(ids, self.end_id)
        ends = np.append(0, np.cumsum(counts[place]))
        lengths = np.diff(ends[first])
        grammar, symbol_counts = compress(place, first, counts, ids, self.encode.n_ids)
        rules = np.stack([grammar.left, grammar.right], 1).astype("<u4").tobytes()
        values = {
            "part": self.part, "shard": self.shard, "before": self.before,
            "n_ids": int(ends[-1]), "first_doc": self.first_doc,
            "first_start": self.first_start, "closed": closed, "base": grammar.base,
            "rules": rules, "sizes": grammar.size.astype("<u4").tobytes(),
            "symbols": grammar.symbols.astype("<u4").tobytes(),
        }
        lists = {
            "doc_ids": doc_ids,
            "lengths": pa.array(lengths, pa.int64()),
            "symbol_counts": pa.array(symbol_counts, pa.int32()),
        }
        edge = pa.array([0, len(lengths)], pa.int32())
        row = pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(edge, lists[f.name]).cast(f.type)
                if f.name in lists
                else pa.array([values[f.name]], f.type)
                for f in self.schema
            ],
            schema=self.schema,
        )
        self.shard += 1
        self.before += int(ends[-1])
        self.first_doc += len(lengths) if closed else len(lengths) - 1
        self.first_start = 0 if closed else self.first_start + int(lengths[-1])
        return row


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode all documents and write their ids, each document closed by ``end_id``, to ``path``.

    Documents come in ascending order of ``doc_id``, null first, and those of equal ids in the
    order of the input. Reads ``doc_id`` and ``text``; a
    null or empty text is the closing id alone, repeated rows are written each, no documents
    give a table without rows. ``vocabulary`` is a file of the ``tokenizers`` or
    ``sentencepiece`` library, present on every machine.

    A shard holds about ``shard_bytes`` of text; a task holds one shard at a time, whatever the
    length of a document (see ``token_counts`` for texts that cannot be split). Equal ids (or no ids at
    all) are dealt over several tasks too, as the input place of a row is part of the order.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = min(max(1, -(-size // PART_BYTES)), MOST_PARTS)
    order = [F.col("doc_id"), F.col("_place")]
    sorted_docs = (
        docs.select(
            "doc_id",
            "text",
            F.monotonically_increasing_id().alias("_place"),
        )
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _SHARD.format(kind=kind)
    spark = docs.sparkSession
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        found = _Shards(encode, end_id, arrow)
        for batch, text, closed in windows(batches, encode, shard_bytes):
            yield found.row(batch.column("doc_id"), text, closed)

    sorted_docs.mapInArrow(shards, schema).write.option("compression", "zstd").parquet(path)


def _grammar(row: dict) -> Grammar:
    def numbers(name: str) -> np.ndarray:
        return np.frombuffer(row[name], "<u4").astype(np.int32)

    rules = numbers("rules").reshape(-1, 2)
    return Grammar(row["base"], rules[:, 0], rules[:, 1], numbers("sizes"), numbers("symbols"))


def _rows(batches: Iterator[pa.RecordBatch], lists: tuple[str, ...]) -> Iterator[dict]:
    """The rows of batches one by one; ``lists`` stay Arrow arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            cells = {n: batch.column(n)[k] for n in batch.schema.names}
            yield {n: c.values if n in lists else c.as_py() for n, c in cells.items()}


def _bases(stored: DataFrame) -> DataFrame:
    """Ids before each part: a running sum over the parts, at most ``MOST_PARTS`` rows."""
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of stored tokens, decoded: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` (with the closing id) and ``ids_crc32`` (of its ids as unsigned
    little-endian 32-bit numbers).

    Shards are decoded once; what comes of them is written before documents that have pieces
    in several shards are put together.
    """
    stored = spark.read.parquet(path)
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    columns = ["doc_id", "part", "start", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, ("doc_ids", "lengths")):
            ids = _grammar(row).all_ids().astype("<u4", copy=False)
            lengths = row["lengths"].to_numpy()
            ends = np.cumsum(lengths)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - lengths, ends)]
            whole = np.ones(len(lengths), bool)
            whole[0] = row["first_start"] == 0
            whole[-1] &= row["closed"]
            yield pa.RecordBatch.from_arrays(
                [
                    row["doc_ids"],
                    pa.array(np.full(len(lengths), row["part"], np.int32)),
                    pa.array(ends - lengths + row["before"]),
                    pa.array(lengths),
                    pa.array(np.array(crc, np.int64)),
                    pa.array(np.arange(len(lengths), dtype=np.int64) + row["first_doc"]),
                    pa.array(whole),
                ],
                names=[*columns, "doc", "whole"],
            )
        give_back()

    pieces = Scratch("pieces").write(
        stored.drop("shard", "symbol_counts").mapInArrow(
            decode,
            f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long, doc long, "
            "whole boolean",
        )
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, total, crc = [], [], []
            for found in batch.column("pieces").to_pylist():
                start.append(found[0]["start"])
                total.append(sum(p["n_tokens"] for p in found))
                value = 0
                for p in found:
                    value = joined(value, p["ids_crc32"], 4 * p["n_tokens"])
                crc.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    *(pa.array(x, pa.int64()) for x in (start, total, crc)),
                ],
                names=columns,
            )

    # A document has as many pieces as shards it fills.
    in_order = F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32")))
    split = pieces.filter("not whole").groupBy("part", "doc")
    closed = split.agg(F.first("doc_id").alias("doc_id"), in_order.alias("pieces")).mapInArrow(
        close, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long"
    )
    documents = pieces.filter("whole").select(columns).unionByName(closed.select(columns))
    return documents.join(_bases(stored), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_spans(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids from ``begin`` (included) to ``end`` of the documents ``wanted`` names.

    ``wanted`` has ``doc_id``, ``begin`` and ``end``; the result these columns, ``at`` (the
    place in the document of the first id given) and ``ids``. A span has a row for every stored
    document of its ``doc_id``, or several where it crosses shards, and none where it meets no
    id. Shards that no span meets are not decoded, and of the others only the symbols met:
    expansion sizes tell which these are.
    """
    stored = spark.read.parquet(path)
    listed = stored.select(
        "part",
        "shard",
        "first_start",
        F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("piece", "of"),
    ).select(
        F.col("of.doc_ids").alias("doc_id"),
        "part",
        "shard",
        "piece",
        F.when(F.col("piece") == 0, F.col("first_start")).otherwise(0).alias("from"),
        F.col("of.lengths").alias("length"),
    )
    begin: Column = F.greatest(F.col("begin") - F.col("from"), F.lit(0))
    end: Column = F.least(F.col("end") - F.col("from"), F.col("length"))
    met = (
        wanted.select("doc_id", F.col("begin").cast("long"), F.col("end").cast("long"))
        .join(listed, "doc_id")
        .withColumns({"low": begin, "high": end})
        .filter("low < high")
    )
    # A shard that many spans meet is decoded several times, for so many spans each.
    turn = F.row_number().over(Window.partitionBy("part", "shard").orderBy("piece", "low"))
    span = F.struct("doc_id", "begin", "end", "from", "piece", "low", "high")
    asked = (
        met.withColumn("turn", (turn / SPANS_TOGETHER).cast("int"))
        .groupBy("part", "shard", "turn")
        .agg(F.collect_list(span).alias("asked"))
        .drop("turn")
    )
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, ("symbol_counts",)):
            grammar = _grammar(row)
            ends = np.append(0, np.cumsum(row["symbol_counts"].to_numpy()))
            found = [
                (
                    *(a[n] for n in ("doc_id", "begin", "end")),
                    a["from"] + a["low"],
                    grammar.part(a["low"], a["high"], ends[a["piece"]], ends[a["piece"] + 1]),
                )
                for a in row["asked"]
            ]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "begin", "end", "at", "ids"), f)) for f in found],
                pa.schema(
                    [
                        ("doc_id", wanted_type),
                        ("begin", pa.int64()),
                        ("end", pa.int64()),
                        ("at", pa.int64()),
                        ("ids", pa.list_(pa.int32())),
                    ]
                ),
            )

    wanted_type = wanted.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    blobs = stored.select("part", "shard", "symbol_counts", "base", "rules", "sizes", "symbols")
    return blobs.join(asked, ["part", "shard"]).mapInArrow(
        decode, f"doc_id {kind}, begin long, end long, at long, ids array<int>"
    )


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` as grammar-compressed tokens in the shared folder and read them back.

    One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (see
    ``write_tokens`` and ``read_documents``).
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path)
    return read_documents(docs.sparkSession, path)
