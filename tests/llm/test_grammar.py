"""Grammar-compressed token files: exact round trips and spans."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logweir.llm.checksums import joined, shifted
from logweir.llm.pair_grammar import compress
from logweir.llm.queries import op11_token_files
from logweir.llm.token_grammar import read_documents, read_spans, write_tokens

from .cases import SCHEMA, awkward_rows, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def grammar_of(docs, base, size=1):
    """The grammar of some lists of ids, cut in pieces of a few."""
    pieces = [tuple(d[k : k + size]) for d in docs for k in range(0, len(d), size)]
    known = list(dict.fromkeys(pieces))
    place = np.array([known.index(p) for p in pieces], np.int64)
    first = np.append(0, np.cumsum([-(-len(d) // size) for d in docs])).astype(np.int64)
    counts = np.array([len(p) for p in known], np.int64)
    flat = np.array([i for p in known for i in p], np.int32)
    return compress(place, first, counts, flat, base)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=6), st.integers(1, 7))
def test_grammar_gives_back_its_ids(docs, size):
    grammar, counts = grammar_of(docs, 4, size)
    flat = [i for d in docs for i in d]
    assert grammar.all_ids().tolist() == flat
    assert grammar.expand(grammar.symbols).tolist() == flat
    at = np.append(0, np.cumsum(counts))
    for doc, a, b in zip(docs, at, at[1:]):
        for begin, end in ((0, len(doc)), (1, 3), (len(doc) // 2, len(doc) + 5), (2, 2)):
            assert grammar.part(begin, end, a, b).tolist() == doc[begin:end]


@pytest.mark.parametrize("size", [1, 3])
def test_frequent_pairs_are_replaced(size):
    ids = list(range(8)) * 500
    grammar, _ = grammar_of([ids], 8, size)
    assert grammar.all_ids().tolist() == ids
    assert len(grammar.symbols) + 2 * len(grammar.size) < len(ids) / 20
    one = [0] * 5000
    grammar, _ = grammar_of([one], 1, size)
    assert len(grammar.symbols) < 20 and grammar.all_ids().tolist() == one


@given(st.lists(st.binary(max_size=40), max_size=5))
def test_checksums_of_joined_pieces(parts):
    value = 0
    for part in parts:
        value = joined(value, zlib.crc32(part), len(part))
    assert value == zlib.crc32(b"".join(parts))


def test_checksums_of_long_pieces():
    head = zlib.crc32(b"head")
    lengths = np.array([0, 1, 300, 1_000_000])
    found = shifted(np.full(4, head, np.uint32), lengths)
    for value, n in zip(found, lengths):
        assert int(value) ^ zlib.crc32(b"x" * n) == zlib.crc32(b"head" + b"x" * n)


def expected(rows):
    """Documents in order: equal ids may come in any order of their texts."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(r[0], len(ids_of(r[1])), crc(ids_of(r[1]))) for r in ordered]


@pytest.mark.parametrize("shard", [300, 20_000, 5_000_000])
def test_documents_come_back(spark, tmp_path, shard):
    rows = awkward_rows()
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark, rows), PATH, path, shard_bytes=shard)
    found = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    wanted = expected(rows)
    assert [r.doc_id for r in found] == [w[0] for w in wanted]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(wanted)


@pytest.mark.parametrize("shard", [300, 5_000_000])
def test_spans_are_decoded_alone(spark, tmp_path, shard):
    rows = [r for r in awkward_rows() if r[0] != 4]
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark, rows), PATH, path, shard_bytes=shard)
    spans = [(5, 0, 10), (5, 95, 310), (15, 20_000, 20_050), (2, 0, 9), (3, 50, 60), (99, 0, 5)]
    wanted = spark.createDataFrame(spans, "doc_id long, begin long, end long")
    found = {}
    for r in read_spans(spark, path, wanted).collect():
        found.setdefault((r.doc_id, r.begin, r.end), []).append((r.at, r.ids))
    for i, begin, end in spans:
        text = next((r[1] for r in rows if r[0] == i), None)
        ids = ids_of(text)[begin:end] if i != 99 else []
        pieces = sorted(found.get((i, begin, end), []))
        assert [x for _, p in pieces for x in p] == ids
        assert all(at == begin + sum(len(p) for _, p in pieces[:k]) for k, (at, _) in enumerate(pieces))


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    at, wanted = 0, []
    for d in docs:
        ids = ids_of(d.text)
        wanted.append((d.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, op11_token_files(spark, folder).collect())) == sorted(wanted)


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(spark.createDataFrame([], SCHEMA), PATH, path)
    assert read_documents(spark, path).count() == 0


def test_rows_without_ids_are_spread(spark, tmp_path):
    path = str(tmp_path / "tokens")
    text = "the same words again and again " * 3000
    docs = spark.createDataFrame([(None, text)] * 1200, "doc_id long, text string").repartition(4)
    write_tokens(docs, PATH, path)
    sizes = [r.n for r in spark.read.parquet(path).groupBy("part").sum("n_ids").toDF("p", "n").collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert read_documents(spark, path).distinct().count() == 1200
