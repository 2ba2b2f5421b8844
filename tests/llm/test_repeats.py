"""N-gram join, span removal and suffix groups against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm import ngram_join, span_dedup
from logweir.llm.anchors import anchors
from logweir.llm.components import components
from logweir.llm.ngram_join import ngram_classes, one_per_class
from logweir.llm.shingles import shingle_sets
from logweir.llm.span_dedup import remove_repeats
from logweir.llm.suffix_groups import suffix_array
from logweir.llm.tables import Scratch
from logweir.llm.words import text_bytes

from .cases import SCHEMA, awkward_rows, frame, words


def lowered(text):
    return re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode())


def shingles(text, width):
    found = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    if len(found) < width:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[k : k + width]) for k in range(len(found) - width + 1))


def root(parent, node):
    while parent[node] != node:
        node = parent[node]
    return node


def brute_classes(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(parent, i), root(parent, j)))
                parent[y] = x
    return sorted(
        ((i, len(s), None if i is None else root(parent, i)) for i, s in sets), key=repr
    )


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_classes_of_awkward_documents(spark, width, percent):
    rows = awkward_rows()
    found = ngram_classes(frame(spark, rows), width, percent, parts=8, chunk_shingles=500)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_classes(rows, width, percent)


def test_large_groups_of_near_copies_are_linked_whole(spark, monkeypatch):
    """Groups above the limit, with strangers that share most of their shingles with them."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    rng = random.Random(9)
    base = words(rng, 120).split(" ")
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"edit{rng.randint(0, 9)}"
        if i % 7 == 0:
            own += words(rng, 22).split(" ")
        rows.append((100 - i, " ".join(own), "en", "a"))
    found = ngram_classes(frame(spark, rows), 4, 85, parts=4)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_classes(rows, 4, 85)


def test_one_document_of_a_class_stays(spark):
    rows = awkward_rows()
    kept = sorted((r.doc_id for r in one_per_class(frame(spark, rows)).collect()), key=repr)
    ids = {c for _, _, c in brute_classes(rows, 5, 80)}
    assert kept == sorted(ids, key=repr)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_classes(empty).count() == 0
    assert one_per_class(empty).count() == 0
    assert remove_repeats(empty).count() == 0


class _Task:
    partitionId = staticmethod(lambda: 0)
    get = classmethod(lambda cls: cls)


def _dealt(monkeypatch, spark, module, make, batches, schema):
    """What the first step of a count sends for these batches."""
    taken = []
    kind = type(spark.range(0))
    whole = kind.mapInArrow

    def spy(self, func, *args, **kwargs):
        taken.append(func)
        return whole(self, func, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    monkeypatch.setattr(module, "TaskContext", _Task)
    make(spark.createDataFrame([], schema))
    return list(taken[0](iter(batches)))


@pytest.mark.parametrize("name", ["shingles", "anchors"])
def test_what_a_count_sends_does_not_grow_with_parts(spark, monkeypatch, name):
    """Many short texts over many parts, and many texts of nothing."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.random():.9f}" for _ in range(10)) for _ in range(3_000)]
    texts += [None, "", " x"] * 40_000
    ids = pa.array(range(len(texts)), pa.int64())
    if name == "shingles":
        batch = pa.record_batch([ids, pa.array(texts)], names=["doc_id", "text"])
        make, module, schema = (
            lambda df: ngram_join._shared_counts(df, 5, 3_000, 10**6), ngram_join, "doc_id long, text string",
        )
    else:
        batch = pa.record_batch([ids, pa.array(texts)], names=["key", "text"])
        make, module, schema = (
            lambda df: span_dedup._shared_anchors(df, 50, 26, 3_000, 20_000), span_dedup, "key long, text string",
        )
    sent = _dealt(monkeypatch, spark, module, make, [batch], schema)
    assert sum(b.nbytes for b in sent) < 12_000_000
    assert max(b.nbytes for b in sent) < 4_000_000


def test_classes_in_chunks_of_few_rows(spark, monkeypatch):
    """Chunks closed by rows change no result."""
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 3, raising=False)
    rows = awkward_rows() + [(50 + k, None, None, None) for k in range(10)]
    found = ngram_classes(frame(spark, rows), 5, 80, parts=300)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_classes(rows, 5, 80)


def test_shingle_sets_do_not_cross_texts():
    texts = ["a b c", "d", None, "", "A B c d"]
    found = shingle_sets(pa.array(texts), 2)
    assert [len(s) for s in found] == [len(shingles(t, 2)) for t in texts]
    assert set(found[0]) <= set(found[4])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = words(rng, 40)
    texts = [words(rng, 9) + shared, shared + words(rng, 5), "ab" * 60, "short", "", "b" + "ab" * 70]
    begin, data = text_bytes(pa.array(texts))
    runs = anchors(begin, data, 50, 26)
    seen, windows = {}, 0
    for first, last, at in zip(runs.first, runs.last, runs.at):
        for s in range(first, last + 1):
            windows += 1
            place = seen.setdefault(data[s : s + 50].tobytes(), at - s)
            assert place == at - s and 0 <= place <= 24
    assert windows == sum(max(0, len(t.encode()) - 49) for t in texts)


def brute_removed(rows, width=50):
    first = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            if i is not None:
                s = raw[k : k + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if i is not None and first[raw[k : k + width]] < i:
                gone[k : k + width] = True
        kept = bytes(b for b, x in zip(raw, gone) if not x)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("common", [2000, 1])
def test_removed_bytes_of_awkward_documents(spark, common):
    rng = random.Random(4)
    rows = awkward_rows()
    passage = words(rng, 20)
    for k in range(25):
        rows.append((40 - k, words(rng, k % 5) + passage[: 40 + 5 * k] + words(rng, 6), "en", "a"))
    found = remove_repeats(frame(spark, rows), parts=8, common=common)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_removed(rows)


@pytest.mark.parametrize("band", [1, 5, 24])
def test_contexts_that_nearly_agree(spark, monkeypatch, band):
    """Passages that end one byte before, at, or behind the length of a string, at any place."""
    monkeypatch.setattr(span_dedup, "BAND", band)
    rng = random.Random(band)
    passage = words(rng, 20)
    rows = []
    for k in range(90):
        size = rng.choice([27, 40, 46, 49, 49, 50, 51, 60])
        at = rng.randrange(40)
        noise = bytes(rng.choice(b"qzxj") for _ in range(60)).decode()
        rows.append((k, noise[: rng.randrange(60)] + passage[at : at + size] + noise, "en", "a"))
    found = remove_repeats(frame(spark, rows), parts=3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_removed(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)]
    edges += [(None, 3), (7, 7)]
    parent = {n: n for e in edges for n in e}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(parent, a), root(parent, b)))
            parent[y] = x
    nodes = {n for a, b in edges if None not in (a, b) and a != b for n in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch("test"))
    assert {r.node: r.component for r in found.collect()} == {n: root(parent, n) for n in nodes}
    assert found.count() == len(nodes)
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, Scratch("test")).count() == 0
