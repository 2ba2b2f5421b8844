"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from logweir.llm.queries import op13_spelling_variants
from logweir.llm.spelling_variants import spelling_variants, word_counts

from .cases import SCHEMA, awkward_rows, frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ALPHABET = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]


def brute_counts(rows, letters=6, drop=None):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            if drop:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % drop == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return found


def edits(word):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b[1:] for a, b in cuts if b for c in ALPHABET}
    out |= {a + c + b for a, b in cuts for c in ALPHABET}
    return out - {word}


def brute_variants(counts, fewest=5, times=5):
    n = {w: c for w, c in counts.items() if c >= fewest}
    near = {w: sorted((x for x in edits(w) if x in n), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= times * n[w] else None for w, x in near.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("drop", [None, 3, 199])
def test_counts_of_awkward_documents(spark, drop):
    rows = [*awkward_rows(), (77, "ÉCOLE×÷ école Écoles ŒUVRE naïve-NAÏVE " + "z" * 500, None, None)]
    for letters in (1, 6):
        found = word_counts(frame(spark, rows), letters, drop).collect()
        assert {r.word: r.n for r in found} == dict(brute_counts(rows, letters, drop))


def vocabulary(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(6, 9))) for _ in range(60)]
    found = Counter()
    for word in base:
        found[word] += rng.choice([5, 30, 200, 5000, 100_000])
        for _ in range(8):
            variant = rng.choice(sorted(edits(word)))
            found[variant] += rng.choice([1, 4, 5, 6, 25, 150, 3000])
            found[rng.choice(sorted(edits(variant)))] += rng.choice([5, 7, 40])
    found["x" * 300] += 9
    found["x" * 299] += 90
    found["é" * 6] += 5
    found["é" * 7] += 5
    return found


@pytest.mark.parametrize(("seed", "room"), [(1, 10**7), (2, 10**7), (3, 400)])
def test_variants_equal_brute_force(spark, seed, room):
    counts = vocabulary(seed)
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    found = spelling_variants(df, filter_bytes=room)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = brute_variants(counts)
    assert {tuple(r) for r in found.collect()} == wanted
    assert any(root not in (w, form) for w, form, root, *_ in wanted)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = brute_variants(brute_counts(docs, drop=199))
    found = [tuple(r) for r in op13_spelling_variants(spark, folder).collect()]
    assert len(found) == len(wanted) > 100 and set(found) == wanted


def test_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(word_counts(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (3, "12 ab", "a", "b")], SCHEMA)
    assert spelling_variants(word_counts(blank, drop_every=199)).count() == 0
