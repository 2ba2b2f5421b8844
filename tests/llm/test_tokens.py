"""Token counts and packing against the library itself."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logweir.llm.packing import pack
from logweir.llm.packing_plan import combinations, head_units, make_plan, nnls
from logweir.llm.pieces import Pieces, WholeTexts, encoder, places_in
from logweir.llm.token_counts import token_counts

from .cases import SCHEMA, awkward_rows, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.text(st.sampled_from(list("ab1 .'\n\t é　 日<|>")), max_size=30), max_size=8
    )
)
def test_pieces_are_the_ids_of_the_library(texts):
    texts = [*texts, "x<|endoftext|> y", None, "", "   a", "a   "]
    counts, ids = encoder(PATH).encode(pa.array(texts, pa.string()))
    at = 0
    for text, count in zip(texts, counts):
        assert ids[at : at + count].tolist() == ids_of(text)
        at += count
    assert encoder(PATH).counts(pa.array(texts, pa.string())).tolist() == counts.tolist()


@pytest.mark.parametrize(
    ("name", "kind"),
    [("byte_bpe_50k.json", Pieces), ("word_bpe_49k.json", WholeTexts), ("piece_bpe_32k.model", WholeTexts)],
)
def test_vocabularies_take_their_path(spark, name, kind):
    path = public_tokenizers.path(name)
    assert isinstance(encoder(path), kind)
    docs = spark.createDataFrame([(1, "Hello big world"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()}
    assert found[1] >= 3 and found[2] in (0, *range(3))


def test_counts_of_awkward_documents(spark):
    rows = awkward_rows()
    found = token_counts(frame(spark, rows), PATH, batch_bytes=1000).collect()
    expected = [
        (i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 1024) for i, t, *_ in rows
    ]
    assert Counter(map(tuple, found)) == Counter(expected)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("aZ1 .'s,-(\n\r\t é×　日<|>")), max_size=200), st.integers(1, 20))
def test_windows_of_a_long_text_have_its_ids(text, limit):
    pieces = encoder(PATH)
    found = [w[0].as_py() for w in pieces.windows(pa.array([text]), limit)]
    assert "".join(found) == text
    ids = [i for w in found for i in ids_of(w)]
    assert ids == ids_of(text)


def test_long_texts_take_bounded_room(spark):
    text = "日本語のテキスト、" * 250_000 + "plain words and more. " * 250_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH, batch_bytes=1_000_000).collect()}
    words, signs = (len(ids_of(x)) for x in ("plain words and more. " * 2, "日本語のテキスト、" * 2))
    once = len(ids_of("plain words and more. "))
    assert found[2] == len(ids_of("x" * 200_000))
    # Every repetition after the first has the same ids.
    step, jump = words - once, signs - len(ids_of("日本語のテキスト、"))
    assert abs(found[1] - 250_000 * (step + jump)) < 20
    assert encoder(PATH).kept.nbytes < 30_000_000


def test_lookup_among_kept_pieces_takes_room_for_the_batch_only():
    kept = pa.array([f"piece {k}" for k in range(300_000)], pa.large_string())
    values = pa.array(["new", "piece 299999", "", "piece 0"], pa.large_string())
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        found = places_in(kept, values)
    finally:
        pa.set_memory_pool(before)
    assert found.tolist() == [-1, 299_999, -1, 0]
    assert pool.max_memory() < 5_000_000
    assert places_in(kept.slice(0, 0), values).tolist() == [-1] * 4
    assert places_in(kept, values.slice(0, 0)).tolist() == []


def test_combinations_fill_the_window():
    assert sorted(combinations(6, 3)) == sorted(
        [(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)]
    )


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        matrix, wanted = rng.random((12, 30)), rng.random(12)
        x = nnls(matrix, wanted)
        gradient = matrix.T @ (wanted - matrix @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient[x > 0]).max() < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=12))
def test_plan_uses_each_piece_once_and_overfills_nothing(histogram):
    plan = make_plan(histogram, 32)
    used = Counter()
    for pattern in plan.patterns:
        filled = 0
        for item, times in pattern.items:
            units, form = divmod(item, 3)
            head = head_units(units) if form else 0
            size = (units, head, units - head)[form]
            filled += size * times
            used[item] += pattern.repeats * times
        assert filled <= 32
    for units, count in histogram.items():
        assert used[3 * units] + used[3 * units + 1] == count
        assert used[3 * units + 1] == used[3 * units + 2]


def check_packing(rows, found, length):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(np.array([*ids_of(t), 1], "<u4"))
    per_doc, per_sequence = {}, {}
    for r in found:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert per_doc.keys() == texts.keys()
    for i, pieces in per_doc.items():
        known = [x for x in texts[i]]
        assert sum(r.length for r in pieces) == sum(map(len, known))
        for r in pieces:
            assert any(
                len(x) == r.doc_tokens
                and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
                for x in known
            )
        if len(known) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for spans in per_sequence.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length


def test_packing_round_trip(spark):
    rows = awkward_rows()
    found = pack(frame(spark, rows), PATH).collect()
    check_packing(rows, found, 2048)


def test_packing_has_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = pack(docs, PATH).collect()
    check_packing([(r.doc_id, r.text) for r in docs.collect()], found, 2048)
    sizes = Counter()
    for r in found:
        sizes[r.sequence_id] += r.length
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding < 0.03 * sum(sizes.values())


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts(empty, PATH).count() == 0
    assert pack(empty, PATH).count() == 0
