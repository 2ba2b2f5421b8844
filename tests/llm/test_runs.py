"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm.periodic_runs import find_runs, periodic_runs, with_planted_runs
from logweir.llm.queries import op12_periodic_runs
from logweir.llm.recompression import RunLengthGrammar

from .cases import SCHEMA, awkward_rows, frame

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANKS.split(text or "") if w]


def brute_runs(words, times=3, least=24):
    """Every maximal stretch of every period, the smallest period of each stretch."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if length >= max(least, times * q):
                found.setdefault((at, length), q)
            at = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, plant=True):
    words = planted(doc_id, words_of(text)) if plant else words_of(text)
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = (None,) * 4
    if runs:
        best = runs[0]
        for r in runs[1:]:
            if r[1] * best[2] > best[1] * r[2]:
                best = r
        top = (*best, 1000 * best[1] // best[2])
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(runs), *top, runs, kept


def as_digests(row):
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in row[6])
    return (*row[:6], digest(lines), digest(row[7]))


texts = st.lists(
    st.one_of(
        st.lists(st.integers(0, 2), max_size=20),
        st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 30)).map(
            lambda x: x[0] * x[1]
        ),
    ),
    max_size=4,
).map(lambda parts: [i for p in parts for i in p])


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_extensions_are_exact(docs):
    flat = [(t, k, s) for t, d in enumerate(docs) for k, s in enumerate(d)]
    ends = np.cumsum([len(d) for d in docs])
    grammar = RunLengthGrammar(np.array([s for *_, s in flat], np.int64), ends)
    rng = np.random.default_rng(len(flat))
    if len(flat) < 2:
        return
    a, b = rng.integers(0, len(flat), (2, 60))
    a, b = a[a != b], b[a != b]
    shift = np.array([t + 1 for t, *_ in flat])
    right = grammar.extension(a + shift[a], b + shift[b])
    left = grammar.extension(a + shift[a], b + shift[b], -1)
    for x, y, forward, backward in zip(a, b, right, left):
        (t, i, _), (u, j, _) = flat[x], flat[y]
        n = 0
        while i + n < len(docs[t]) and j + n < len(docs[u]) and docs[t][i + n] == docs[u][j + n]:
            n += 1
        assert forward == n
        n = 0
        while i >= n and j >= n and docs[t][i - n] == docs[u][j - n]:
            n += 1
        assert backward == n


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.sampled_from([(3, 24), (3, 6), (4, 10)]))
def test_runs_equal_brute_force(docs, rule):
    symbols = np.array([i for d in docs for i in d], np.int64)
    first = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
    found = list(zip(*(x.tolist() for x in find_runs(symbols, first, *rule))))
    wanted = [(t, *r) for t, d in enumerate(docs) for r in brute_runs(d, *rule)]
    assert found == wanted


def test_awkward_documents(spark):
    rows = [r for r in awkward_rows() if r[0] != 15]
    rows.append((20, "a b " * 40 + "c " + "a b " * 40, None, None))
    rows.append((21, " \n".join(["x y z"] * 30 + ["q"] + ["é"] * 50), None, None))
    found = periodic_runs(frame(spark, rows)).collect()
    wanted = [expected(r[0], r[1], plant=False) for r in rows]
    got = [
        (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed)
        for r in found
    ]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_runs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [
        (int(i), "  ".join(rng.choice(list("abcdef"), rng.integers(0, 200))), None, None)
        for i in rng.integers(-50, 10**6, 300)
    ]
    rows += [(None, "a b c", None, None), (7, None, None, None)]
    found = with_planted_runs(frame(spark, rows)).collect()
    wanted = sorted(((i, planted(i, words_of(t))) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, words_of(r.text)) for r in found), key=repr) == wanted


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {tuple(r) for r in op12_periodic_runs(spark, folder).collect()}
    short = [d for d in docs if len(words_of(d.text)) < 3000]
    wanted = {as_digests(expected(d.doc_id, d.text)) for d in short}
    assert wanted <= found and len(found) == len(docs)
    assert any(w[1] for w in wanted) and len(short) > 0.9 * len(docs)


def test_a_long_periodic_text(spark):
    text = "one two three four five " * 40_000
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 200_000, 5)]
    assert row.collapsed == "one two three four five" and row.exponent_milli == 40_000_000


def test_no_documents(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
