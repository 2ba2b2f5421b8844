"""Language identification, mixing and nearest neighbours."""

import math
import random
from collections import Counter
from hashlib import md5

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from logweir.llm.language_id import (
    Model,
    fit,
    letter_words,
    predict,
    recognised,
    vocabulary,
    word_scores,
)
from logweir.llm.mixing import SCHEDULES, mix, mixed_documents
from logweir.llm.nearest import COLLISIONS, SHARES, SURE, TABLES, Block, Shell, nearest

from .cases import SCHEMA, awkward_rows, by_row, frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.01"


def test_forward_pass_sums_all_segmentations():
    pieces = vocabulary(PIECES)
    chance = np.random.default_rng(0).random((len(pieces), 2)) / len(pieces)
    for word in (" the", " zéb", " a", " qqx"):
        raw = word.encode()
        place = {}
        for begin, end, rows, found in pieces.cuts(np.frombuffer(raw, np.uint8)[None]):
            place[begin, end] = found[0]

        def total(begin, lang, place=place, size=len(raw)):
            if begin == size:
                return 1.0
            return sum(
                chance[p, lang] * total(e, lang) for (b, e), p in place.items() if b == begin
            )

        scores = word_scores(pieces, np.frombuffer(raw, np.uint8)[None], chance)
        assert scores[0] == pytest.approx([math.log(total(0, k)) for k in (0, 1)])


def test_letter_words():
    coded, first = letter_words(pa.array(["Ab, été 12x", None, "", "Z", "a" * 100]))
    words = [coded.dictionary[i].as_py().decode() for i in coded.indices.to_pylist()]
    assert words == [" ab", " été", " x", " z", " " + "a" * 48, " " + "a" * 48, " aaaa"]
    assert first.tolist() == [0, 3, 3, 3, 4, 7]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = fit(docs, PIECES, rows=200, rounds=2)
    found = predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert recognised(docs, model).columns == docs.columns
    assert recognised(docs, model).count() > 0.98 * len(found)
    awkward = {r.doc_id: r for r in predict(frame(spark, awkward_rows()), model).collect()}
    assert len(awkward) == 16
    for i in (1, 2, 3, 13):
        assert (awkward[i].lang_pred, awkward[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = fit(empty, PIECES)
    assert isinstance(model, Model) and model.languages == []
    assert predict(empty, model).count() == 0
    rows = [(1, "text", None, None)]
    assert predict(frame(spark, rows), model).first().lang_pred == "und"


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    left, target = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in target]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    rows = awkward_rows()
    for k in range(200):
        source = rng.choice(["a", "a", "a", "b", "é", "Z", None, f"s{k % 5}"])
        rows.append((100 + k, " ".join("w" * (k % 3 + 1) for _ in range(rng.randint(0, 80))), None, source))
    found = mix(frame(spark, rows), buckets=4).collect()
    assert len(found) == len(rows)
    source = {i: s for i, _, _, s in rows}
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    targets = brute_targets(sizes)
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert by_row(mix(frame(spark, rows), buckets=4)) == sorted(map(tuple, found), key=repr)


def test_positions_follow_the_schedule(spark):
    """At each time a growing source has given the integral of its weight."""
    rows = [(k, "w " * 50, None, "a") for k in range(400)]
    found = sorted(p for r in mix(frame(spark, rows)).collect() for p in r.positions)
    (_, low), (_, high) = SCHEDULES[0]
    for time in (0.25, 0.5, 0.75):
        due = low * time + (high - low) * time * time / 2
        assert sum(p < time for p in found) / len(found) == pytest.approx(due, abs=0.01)


def test_mixed_documents(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", "ab"[k % 2]) for k in range(60)]
    docs = frame(spark, rows)
    times = Counter(r.doc_id for r in mixed_documents(docs).collect())
    for r in mix(docs).collect():
        assert abs(times[r.doc_id] - r.taken / r.size) <= 0.5
    assert mixed_documents(docs).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == mixed_documents(empty).count() == 0
    assert mix(spark.createDataFrame([(1, None, None, None)], SCHEMA)).first().taken == 0


def test_recall(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = vectors.collect()
    matrix = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in nearest(vectors, block_rows=200, query_rows=10).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, answers in found.items():
        answers.sort()
        assert [a[0] for a in answers] == list(range(1, 21))
        own = matrix[ids == q][0]
        for _, i, score in answers:
            assert score == pytest.approx(float(matrix[ids == i][0] @ own), rel=1e-12)
        order = sorted((-float(m @ own), i) for m, i in zip(matrix, ids) if i != q)[:20]
        hits += len({i for _, i in order} & {a[1] for a in answers})
    assert hits >= 0.9 * 20 * len(found)


def test_rows_without_or_with_one_id_are_mixed_each_by_itself(spark):
    rng = random.Random(4)
    ids = [*range(30), *[None] * 20, *[7] * 10]
    sizes = rng.sample(range(5, 200), len(ids))
    rows = [(i, "w " * n, "en", rng.choice(["a", "b", None])) for i, n in zip(ids, sizes)]
    sums = Counter()
    for _, text, _, source in rows:
        sums[source] += text.count("w")
    targets = brute_targets(sums)
    expected = Counter()
    for source in sums:
        ring = [(md5(str("" if i is None else i).encode()).hexdigest(), i or -1, t.count("w"), i)
                for i, t, _, s in rows if s == source]
        demand, offset = math.floor(targets[source] + 0.5), 0
        for _, _, size, i in sorted(ring, key=lambda r: r[:3]):
            part = max(0, min(demand % sums[source] - offset, size))
            taken = demand // sums[source] * size + part
            expected[i, size] += math.floor(taken / size + 0.5)
            offset += size
    found = Counter((r.doc_id, r.text.count("w")) for r in mixed_documents(frame(spark, rows)).collect())
    assert found == +expected


@pytest.mark.parametrize("case", ["copies", "norms", "both"])
def test_recall_with_copies_and_mixed_norms(spark, case):
    """A third of the rows are one vector; some have norms up to ten times the others'."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64))
    matrix = centres[np.arange(1200) % 20] + 2 * rng.standard_normal((1200, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    if case != "copies":
        matrix *= rng.choice([1, 1, 1, 0.5, 2], (1200, 1))
        matrix[7] *= 10
    if case != "norms":
        matrix[rng.random(1200) < 1 / 3] = matrix[11]
    ids = np.arange(1200)
    df = spark.createDataFrame(
        [(i, m) for i, m in zip(ids.tolist(), matrix.tolist())], "vec_id long, embedding array<double>"
    )
    found = {}
    for r in nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recalls = []
    for q in ids[::20]:
        order = [i for i in np.lexsort((ids, -(matrix @ matrix[q]))) if i != q][:20]
        recalls.append(len(found[q] & set(order)) / 20)
    assert np.mean(recalls) >= 0.95 and min(recalls) >= 0.7


def test_a_query_verifies_a_falling_share_of_a_growing_block(monkeypatch):
    """Eight times the vectors of a block are less than four times the vectors verified."""
    rng, met, verified = np.random.default_rng(5), Shell.met, []

    def counted(*args):
        found = met(*args)
        verified.append(len(found))
        return found

    monkeypatch.setattr(Shell, "met", counted)
    work = []
    for n in (3_000, 24_000):
        matrix = rng.standard_normal((n, 64))
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        ids = np.arange(n)
        asked = ids[: 60 * 20 : 20]
        verified.clear()
        found = Block(ids, matrix, TABLES).nearest(
            asked, matrix[asked], 20, SHARES, COLLISIONS, SURE
        )
        # Steps hold what earlier ones held; their sum bounds what a query reads from above.
        work.append(sum(verified) / len(asked))
        hits = 0
        for q, (answers, scores) in zip(asked, found):
            every = matrix @ matrix[q]
            every[q] = -np.inf
            assert np.allclose(scores, every[answers], rtol=1e-12)
            hits += len(set(np.argsort(-every)[:20]) & set(answers))
        assert hits >= 0.95 * 20 * len(asked)
    assert work[1] < 4 * work[0]


@pytest.mark.parametrize("collisions", [1, 2, 4])
def test_met_counts_the_windows_a_vector_lies_in(collisions):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((400, 8))
    norms = np.linalg.norm(vectors, axis=1)
    shell = Shell(np.arange(400), vectors, norms, 12)
    query = (rng.standard_normal(8) / 3).astype(np.float32)
    ((first, second),) = shell.places(query[None])
    # The cell of each vector in each table, from the tables' spans.
    cells = (2 * shell.lines) ** 2
    for least in (0.2, 0.6, 1.2, 50.0):
        times = Counter()
        for table in range(12):
            for cell in range(cells):
                i, j = divmod(cell, 2 * shell.lines)
                if first[table, i] + second[table, j] >= least:
                    at = table * cells + cell
                    times.update(shell.order[shell.begin[at] : shell.begin[at + 1]].tolist())
        expected = sorted(v for v, n in times.items() if n >= collisions)
        assert shell.met(first, second, least, collisions).tolist() == expected


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [-1.0, 0.5]), (40, None), (60, [0.0, 0.0]), (1, [nan, 1.0]),
        (2, [inf, 1.0]), (3, [None, 1.0]), (4, []), (5, [3.0, 1.0]), (6, [3.0, 1.0]),
        (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [-100.0, 2.0]), (80, [2.0]), (0, [1.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "'x' as block", "'y' as part", "'z' as dims", "1 as score")
    found = by_row(nearest(df))
    good = {0: [1, 2], 20: [-1, 0.5], 5: [3, 1], 6: [3, 1], 8: [-100, 2]}
    expected = []
    for q in (0, 20):
        order = sorted(
            (-float(np.dot(good[q], v)), i) for i, v in [*good.items(), (0, good[0])] if i != q
        )
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert found == sorted(expected, key=repr)
    assert nearest(df.limit(0)).count() == 0
