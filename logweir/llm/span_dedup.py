"""Removal of byte strings that an earlier document holds, by sorted suffixes.

Equal strings of the fixed length share an anchor, so the strings around one anchor are
compared with each other only. Contexts of an anchor that differ are put one after the other
and their suffixes are sorted (see ``logweir.llm.suffix_groups``); equal strings are neighbours
there, and the smallest document of each class keeps its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.anchors import Runs, anchors
from logweir.llm.pieces import runs
from logweir.llm.suffix_groups import suffix_array
from logweir.llm.tables import Scratch
from logweir.llm.words import CHUNK_ROWS, hash_parts, mix64, sent, slices, text_bytes

STRING = 50
GRAM = 26
CHUNK_ANCHORS = 1_000_000
# An anchor in more documents than this is compared string by string, each under a key of its
# own, so that no task gets all its contexts.
COMMON = 20_000
# Texts whose contexts are compared before they are dealt out, in bytes.
CONTEXT_BYTES = 2_000_000
# Places of an anchor in a string that are told apart together when contexts are compared.
BAND = 5
BROADCAST_IDS = 1_000_000

_LOW = np.uint64((1 << 40) - 1)
_COMMON_BIT = np.int64(1) << np.int64(62)


def _codes(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of the hash space and 40 bits inside it, as one number."""
    mixed = mix64(hashes)
    part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return ((part << np.uint64(40)) | (mixed & _LOW)).astype(np.int64)


def _runs(column: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, Runs, np.ndarray]:
    begin, data = text_bytes(column)
    found = anchors(begin, data, window, gram)
    owner = np.searchsorted(begin, found.first, "right") - 1
    return begin, data, found, owner


def _bytes(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _shared_anchors(docs: DataFrame, window: int, gram: int, parts: int, common: int) -> DataFrame:
    """``key`` and ``codes``: the anchors of a document that another one has too.

    Codes of anchors in more than ``common`` documents carry a mark. As with shingles, what
    documents of one chunk share is settled there and leaves it once, and beside each code
    stands the number of its document. Documents without anchors are left out.
    """
    columns = pa.schema(
        [("part", pa.int64()), ("chunk", pa.int64())]
        + [(n, pa.binary()) for n in ("owners", "low", "high", "times")]
    )

    def rows_of(chunk: int, keys: list, found: list[np.ndarray]) -> Iterator[tuple]:
        flat = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        times = np.diff(np.append(np.flatnonzero(first), len(ranked)))
        many = np.repeat(times, times) > 1
        values, owners = ranked[first], owner[order[first]]
        owners = np.where(times == 1, owners, len(found))
        cuts = np.searchsorted(values >> 40, np.arange(parts + 1))
        for k in np.unique(values >> 40).tolist():
            some = slice(cuts[k], cuts[k + 1])
            by_owner = np.argsort(owners[some], kind="stable")
            held, own = values[some][by_owner], owners[some][by_owner]
            owned = np.searchsorted(own, len(found))
            yield (
                k,
                chunk,
                _bytes(own[:owned], "<u2"),
                _bytes(held & 0xFFFFFFFF, "<u4"),
                _bytes((held >> 32) & 0xFF, "u1"),
                _bytes(times[some][by_owner][owned:], "<u4"),
            )
        settled = _bytes(owner[order[many]], "<u4"), _bytes(ranked[many], "<i8")
        yield -1 - chunk, chunk, _bytes(np.array(keys), "<i8"), *settled, b""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        keys, found, held = [], [], 0
        for batch in slices(batches):
            _, _, around, owner = _runs(batch.column("text"), window, gram)
            codes = _codes(around.hash, parts)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            some = np.flatnonzero(np.diff(ends))
            keys += batch.column("key").take(pa.array(some)).to_pylist()
            found += [np.unique(codes[ends[k] : ends[k + 1]]) for k in some]
            held += len(codes)
            if held >= CHUNK_ANCHORS or len(keys) >= CHUNK_ROWS:
                yield from sent(rows_of(chunk, keys, found), columns)
                chunk, keys, found, held = chunk + 1, [], [], 0
        if keys:
            yield from sent(rows_of(chunk, keys, found), columns)

    answer = pa.schema(
        [("chunk", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("codes", pa.binary())]
    )

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:
            return pa.table([table["chunk"], table["owners"], table["low"], table["high"]], answer)
        owners, values, weights = [], [], []
        for row in table.select(["owners", "low", "high", "times"]).to_pylist():
            own = np.frombuffer(row["owners"], "<u2").astype(np.int64)
            high = np.frombuffer(row["high"], "u1").astype(np.int64) << 32
            nobodys = np.frombuffer(row["times"], "<u4")
            owners.append(np.append(own, np.full(len(nobodys), 0xFFFFFFFF)))
            values.append(np.frombuffer(row["low"], "<u4") | high)
            weights.append(np.append(np.ones(len(own), np.int64), nobodys))
        flat = np.concatenate(values)
        order = np.argsort(flat)
        edge = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))[: len(flat)]
        total = np.empty(len(flat), np.int64)
        if len(flat):
            sums = np.add.reduceat(np.concatenate(weights)[order], edge)
            total[order] = np.repeat(sums, np.diff(np.append(edge, len(flat))))
        rows, at = [], 0
        for own, some in zip(owners, values):
            often = total[at : at + len(some)]
            at += len(some)
            # Nobody's are answered only where they are common.
            keep = (often > 1) & ((own != 0xFFFFFFFF) | (often > common))
            codes = (np.int64(part) << 40) | some[keep] | np.where(often[keep] > common, _COMMON_BIT, 0)
            rows.append((b"", _bytes(own[keep], "<u4"), _bytes(codes, "<i8")))
        columns = [pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]
        return pa.table([table["chunk"], *columns], answer)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["keys"])
        keys = np.frombuffer(own["keys"], "<i8")
        parts_ = [r for r in rows if not r["keys"]]
        owners = np.frombuffer(b"".join(r["owners"] for r in parts_), "<u4")
        codes = np.frombuffer(b"".join(r["codes"] for r in parts_), "<i8")
        wide = np.unique(codes[owners == 0xFFFFFFFF] & ~_COMMON_BIT)
        local_owner = np.frombuffer(own["owners"], "<u4")
        local = np.frombuffer(own["codes"], "<i8")
        local = np.where(np.isin(local, wide), local | _COMMON_BIT, local)
        owner = np.concatenate([owners[owners != 0xFFFFFFFF], local_owner])
        code = np.concatenate([codes[owners != 0xFFFFFFFF], local])
        order = np.argsort(owner, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(keys))))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order]))
        result = pa.table({"key": keys, "codes": lists})
        return result.filter(pa.array(np.diff(ends) > 0))

    dealt = docs.mapInArrow(
        deal, "part long, chunk long, owners binary, low binary, high binary, times binary"
    )
    counted = dealt.groupBy("part").applyInArrow(
        count, "chunk long, keys binary, owners binary, codes binary"
    )
    return counted.groupBy("chunk").applyInArrow(gather, "key long, codes array<long>")


CONTEXT = (
    "part long, key long, doc_id long, code long, mark long, first long, length long, "
    "anchor long, context binary"
)
# Codes of strings of common anchors, apart from those of anchors.
_STRING_BIT = np.int64(1) << np.int64(61)


_STEP = np.uint64(0xD6E8FEB86659FD93)


class _Marks:
    """Hashes of any stretch of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        step = np.full(len(data) + 1, _STEP, np.uint64)
        back = np.full(len(data) + 1, pow(int(_STEP), -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        powers, self.back = step.cumprod(dtype=np.uint64), back.cumprod(dtype=np.uint64)
        terms = mix64(data.astype(np.uint64) + np.uint64(77)) * powers[:-1]
        self.sums = np.append(np.uint64(0), terms.cumsum(dtype=np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        length = (end - start).astype(np.uint64)
        return mix64(value ^ mix64(length * np.uint64(1 << 20) + salt.astype(np.uint64)))


def _owned(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64)) + owner.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)


def _least(order: np.ndarray, ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows in this order begin to differ in the keys, and the smallest id up to there."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(new)
    return heads, np.minimum.reduceat(ids[order], heads)


def _contexts(docs: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """A row per run of strings around a shared anchor, and settled spans under negative parts.

    ``context`` has the bytes before and behind the anchor, whose own the code stands for.
    Strings of common anchors are rows of their own, under the code of their bytes. Of equal
    contexts in a batch only the smallest document's go on; the others are settled.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CONTEXT_BYTES):
            begin, data, found, owner = _runs(batch.column("text"), window, gram)
            codes = _codes(found.hash, parts)
            keys, ids = (batch.column(n).to_numpy() for n in ("key", "doc_id"))
            lists = batch.column("codes")
            own = lists.flatten().to_numpy()
            own_doc = lists.value_parent_indices().to_numpy()
            common = own >= _COMMON_BIT
            own = own & ~_COMMON_BIT
            mine = _owned(codes, owner)
            shared = np.isin(mine, _owned(own, own_doc))
            wide = np.isin(mine, _owned(own[common], own_doc[common]))
            marks = _Marks(data)

            some = np.flatnonzero(shared & ~wide)
            start, end, at = found.first[some], found.last[some] + window, found.at[some]
            mark = marks.of(start, end, at - start)
            many = np.flatnonzero(wide)
            counts = found.last[many] - found.first[many] + 1
            single = runs(found.first[many], counts)
            string = marks.of(single, single + window, np.zeros(len(single)))
            doc = np.concatenate([owner[some], np.repeat(owner[many], counts)])
            code = np.concatenate([codes[some], _codes(string, parts) | _STRING_BIT])
            mark = np.concatenate([mark, string]).view(np.int64)
            start, end = np.concatenate([start, single]), np.concatenate([end, single + window])
            anchor = np.concatenate([at, np.full(len(single), -1)])
            if not len(code):
                continue
            order = np.lexsort((mark, code))
            heads, least = _least(order, ids[doc], code, mark)
            beaten = np.empty(len(code), bool)
            beaten[order] = ids[doc][order] > np.repeat(least, np.diff(np.append(heads, len(order))))

            first = start - begin[doc]
            late = np.flatnonzero(beaten)
            done, packed = _packed(doc[late], first[late], first[late] + (end - start)[late])
            go = np.flatnonzero(~beaten)
            # The bytes on both sides of the anchor; none of a single string.
            narrow = anchor[go] >= 0
            left = np.where(narrow, anchor[go] - start[go], 0)
            right = np.where(narrow, end[go] - anchor[go] - gram, 0)
            places = np.column_stack([start[go], anchor[go] + gram]).ravel()
            sizes = np.column_stack([left, right]).ravel()
            raw = data[runs(places, sizes)]
            offsets = np.append(0, np.cumsum(left + right)).astype(np.int32)
            context = pa.BinaryArray.from_buffers(
                pa.binary(), len(go), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
            )
            part = (code[go] & ~_STRING_BIT) >> 40
            yield _batch(
                part, keys[doc[go]], ids[doc[go]], code[go], mark[go], first[go],
                (end - start)[go], np.where(narrow, left, -1), context,
            )
            if len(done):
                nothing = np.zeros(len(done), np.int64)
                yield _batch(
                    -1 - np.abs(keys[done] % parts), keys[done], ids[done], *[nothing] * 5, packed
                )

    return docs.mapInArrow(emit, CONTEXT)


def _batch(*columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _packed(keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The different keys, and the joined spans of each as packed pairs."""
    if not len(keys):
        return keys, pa.array([], pa.binary())
    names, place = np.unique(keys, return_inverse=True)
    # Far enough apart that spans of two keys never touch.
    room = int(end.max()) + 2
    spans = _joined(np.column_stack([begin + place * room, end + place * room]))
    of = spans[:, 0] // room
    spans -= (of * room)[:, None]
    counts = np.bincount(of, minlength=len(names))
    offsets = np.append(0, np.cumsum(16 * counts)).astype(np.int32)
    raw = np.ascontiguousarray(spans, "<i8")
    packed = pa.BinaryArray.from_buffers(
        pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    )
    return names, packed


def _joined(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans (begin, end), in order; touching ones are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > ends[:-1])
    heads = np.flatnonzero(new)
    return np.column_stack([spans[heads, 0], ends[np.append(heads[1:], len(spans)) - 1]])


def _later_strings(
    groups: np.ndarray, sides: list[bytes], anchor: np.ndarray, least: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, and where in them strings begin that a smaller document has.

    Contexts of one group have the same anchor, put as one symbol between the bytes before
    (``anchor`` of them) and behind it, so that a string has ``width`` symbols. ``least`` is
    the smallest document of each context.
    """
    sizes = np.array([len(x) for x in sides])
    ends = np.cumsum(sizes + 2)
    begins = ends - sizes - 2
    flat = np.zeros(int(ends[-1]), np.int64)
    symbol = np.ones(len(flat), bool)
    symbol[begins + anchor] = False
    symbol[ends - 1] = False
    flat[symbol] = np.frombuffer(b"".join(sides), np.uint8).astype(np.int64) + 1
    flat[begins + anchor] = 257 + groups
    owner = np.repeat(np.arange(len(sides)), sizes + 2)
    ranked = np.array(suffix_array(flat))
    ranked = ranked[(ranked + width) < ends[owner[ranked]]]
    strings = flat[ranked[:, None] + np.arange(width)]
    new = np.append(True, (strings[1:] != strings[:-1]).any(axis=1))
    heads = np.flatnonzero(new)
    smallest = np.minimum.reduceat(least[owner[ranked]], heads)
    beaten = np.repeat(smallest, np.diff(np.append(heads, len(ranked)))) < least[owner[ranked]]
    found = ranked[beaten]
    return owner[found], found - begins[owner[found]]


def _akin(groups: np.ndarray, sides: pa.Array, anchor: np.ndarray, spare: int) -> np.ndarray:
    """Which contexts may share a string with another one of their group.

    A string takes ``spare`` bytes around the anchor, some before and the rest behind it. With
    the number before known up to a band of ``BAND``, two contexts that share such a string
    agree on the bytes all strings of the band have. A context that agrees with none in any
    band shares nothing, so its suffixes need not be sorted.
    """
    held = sides.cast(pa.large_binary())
    _, offsets, raw = held.buffers()
    begin = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(raw or b"", np.uint8)[begin[0] : begin[-1]]
    begin = begin - begin[0]
    marks, middle = _Marks(data), begin[:-1] + anchor
    behind = begin[1:] - middle
    akin = np.zeros(len(groups), bool)
    for low in range(0, spare + 1, BAND):
        before, after = low, max(spare - low - BAND + 1, 0)
        able = np.flatnonzero((anchor >= before) & (behind >= after))
        mark = marks.of(middle[able] - before, middle[able] + after, groups[able])
        _, which, times = np.unique(mark, return_inverse=True, return_counts=True)
        akin[able[times[which] > 1]] = True
    return akin


def _resolve(table: pa.Table, window: int, gram: int) -> pa.Table:
    """Spans to remove, of the contexts of one part of the hash space."""
    if table["part"][0].as_py() < 0:
        return table.select(["key", "context"]).rename_columns(["key", "spans"])
    names = ("key", "doc_id", "code", "mark", "first", "length", "anchor")
    key, ids, code, mark, first, length, anchor = (table[n].to_numpy() for n in names)
    order = np.lexsort((mark, code))
    heads, least = _least(order, ids, code, mark)
    sizes = np.diff(np.append(heads, len(order)))
    beaten = ids[order] > np.repeat(least, sizes)
    late = order[beaten]
    keys, begins, ends = [key[late]], [first[late]], [first[late] + length[late]]

    # Different contexts of one anchor are compared string by string.
    of = code[order[heads]]
    new = np.append(True, of[1:] != of[:-1])
    group = np.cumsum(new) - 1
    mixed = np.flatnonzero((np.bincount(group)[group] > 1) & (anchor[order[heads]] >= 0))
    if len(mixed):
        sides = table["context"].take(pa.array(order[heads[mixed]])).combine_chunks()
        before = anchor[order[heads[mixed]]]
        akin = np.flatnonzero(_akin(group[mixed], sides, before, window - gram))
        mixed, sides = mixed[akin], sides.take(pa.array(akin)).to_pylist()
    if len(mixed):
        rows = order[heads[mixed]]
        width = window - gram + 1
        context, place = _later_strings(group[mixed], sides, anchor[rows], least[mixed], width)
        # Rows of the smallest document of a context; the others go as a whole already.
        holders = np.flatnonzero(~beaten)
        of_row = np.repeat(np.arange(len(heads)), sizes)[holders]
        low = np.searchsorted(of_row, mixed[context])
        times = np.searchsorted(of_row, mixed[context], "right") - low
        row = order[holders[runs(low, times)]]
        start = first[row] + np.repeat(place, times)
        keys.append(key[row])
        begins.append(start)
        ends.append(start + window)
    found, packed = _packed(*(np.concatenate(x) for x in (keys, begins, ends)))
    return pa.table({"key": pa.array(found, pa.int64()), "spans": packed})


def removed_spans(
    docs: DataFrame,
    copies: DataFrame,
    scratch: Scratch,
    window: int,
    gram: int,
    parts: int,
    common: int,
) -> DataFrame:
    """``key`` and ``spans`` (pairs of byte positions, packed) of what to remove.

    ``docs`` has ``key``, ``doc_id`` and ``text``. Copies (by ``key``) are counted, so that
    their firsts are looked at, but hold no string that their first does not.
    """
    shared = _shared_anchors(docs.select("key", "text"), window, gram, parts, common)
    flags = scratch.write(shared.join(copies, "key", "left_anti"))
    ids = flags.select("key").distinct()
    ids = F.broadcast(ids) if flags.count() <= BROADCAST_IDS else ids
    held = docs.join(ids, "key", "left_semi").join(flags, "key")
    contexts = _contexts(held.select("key", "doc_id", "text", "codes"), window, gram, parts)
    found = contexts.groupBy("part").applyInArrow(
        lambda table: _resolve(table, window, gram), "key long, spans binary"
    )
    return found.groupBy("key").agg(F.collect_list("spans").alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = text.encode()
            spans = _joined(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in packed]))
            digest, at = hashlib.sha256(), 0
            for a, b in spans.tolist():
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.string()),
            ],
            names=["key", "cut_bytes", "cut_spans", "cut_sha256"],
        )


def remove_repeats(
    docs: DataFrame,
    window: int = STRING,
    gram: int = GRAM,
    parts: int | None = None,
    common: int = COMMON,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` by row of ``docs``.

    Removes each byte covered by a string of ``window`` bytes that also starts in a document
    of a smaller ``doc_id``; all strings are judged on the input. Reads ``doc_id`` (an integer)
    and ``text`` (null: empty). Rows of one id do not count as earlier than each other, and a
    row without id is neither cut nor earlier than any.

    Texts equal to that of a smaller id go as a whole. For the others one count over anchors
    finds those that several texts have; strings around them are compared in tasks by hash
    part. Texts are joined with their spans only where a part of them goes.
    """
    scratch = Scratch("span-dedup")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    facts = scratch.write(
        rows.select(
            "doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")
        )
    )
    first = facts.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("earliest"))
    facts = scratch.write(facts.join(first, "sha", "left"))
    copy = (F.col("doc_id") > F.col("earliest")) & (F.col("n_bytes") >= window)
    copies = facts.where(copy).select("key").distinct()
    searched = rows.where(F.col("doc_id").isNotNull())
    if parts is None:
        parts = hash_parts(facts.agg(F.sum("n_bytes")).first()[0] or 0)
    spans = scratch.write(removed_spans(searched, copies, scratch, window, gram, parts, common))
    ids = spans.select("key")
    ids = F.broadcast(ids) if spans.count() <= BROADCAST_IDS else ids
    held = searched.join(ids, "key", "left_semi").dropDuplicates(["key"]).join(spans, "key")
    cut = held.select("key", "text", "spans").mapInArrow(
        _cut, "key long, cut_bytes long, cut_spans long, cut_sha256 string"
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return facts.join(cut, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("cut_bytes", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("cut_sha256", "sha")).alias("kept_sha256"),
    )
