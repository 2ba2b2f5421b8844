"""The pipeline and the registered queries."""

import math
import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from logweir.llm.mixing import _mixed, mix
from logweir.llm.oracles import llm_oracles
from logweir.llm.queries import BYTE_VOCABULARY, llm_queries

from .cases import SCHEMA, awkward_rows
from .test_repeats import brute_classes
from .test_tokens import check_packing

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_every_operator_has_one_query():
    names = list(llm_queries())
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(k) for k in range(1, 14)]
    assert set(names) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = llm_queries()[name](spark, SF_DIR)
    columns = ", ".join(found.columns)
    rows = duck.sql(f"SELECT {columns} FROM ({llm_oracles()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_a_stage_run_by_itself_hands_out_text_in_small_batches(spark, stage):
    """The setting has to hold when the lazy result of a stage runs, whoever runs it."""
    spark.conf.set(corpus_pipeline.BATCH_SETTING, "64m")
    rows = [(k, f"word{k} " * 2500, "en", "a") for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "length(text) + 0L AS n_chars").coalesce(1)
    stage(spark, docs, SF_DIR)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes], "n": [batch.num_rows]})

    found = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r.n for r in found) == len(rows)
    assert sum(r.size for r in found) > 10_000_000
    assert max(r.size for r in found) < 5_000_000


def test_stages_over_awkward_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(150)
    rows = [(10_000 + i, t, lang, s) for i, t, lang, s in awkward_rows() if i is not None]
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "length(text) AS n_chars")
    now = docs.unionByName(more.withColumn("n_chars", more.n_chars.cast("long")))
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        stage(spark, now, SF_DIR).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        after = now.collect()
        if k < 4:
            assert now.columns == columns
        if name == "language ID":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert gone == {10_001, 10_002, 10_003, 10_013}
        elif name == "n-gram Jaccard join":
            classes = {c for _, _, c in brute_classes([(r.doc_id, r.text) for r in before], 5, 80)}
            assert sorted(r.doc_id for r in after) == sorted(classes)
        elif name == "secret scans":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing sources":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) > len(before)
        else:
            check_packing([(r.doc_id, r.text) for r in before], after, 2048)


def test_stages_over_rows_without_or_with_one_id(spark, tmp_path):
    """Each stage on its own, over null and repeated ids: rows come by their own takings."""
    rows = awkward_rows() + [(None, f"no id {k} " * (k + 1), "en", "a") for k in range(8)]
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "length(text) AS n_chars")
    more.withColumn("n_chars", more.n_chars.cast("long")).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = Counter(map(tuple, stage(spark, docs, SF_DIR).collect()))
        if name == "mixing sources":
            times = Counter()
            for r in mix(docs).collect():
                times[r.doc_id, r.size] += math.floor(r.taken / r.size + 0.5) if r.size else 0
            found = Counter()
            for (i, text, *_), n in after.items():
                found[i, len(text.split())] += n
            assert found == +times
        elif name == "secret scans":
            assert after.total() == len(rows)
        else:
            assert after <= Counter(map(tuple, docs.collect()))


def test_packing_stage_over_rows_without_or_with_one_id(spark):
    rows = awkward_rows() + [(7, f"one id {k} " * (k + 1), "en", "a") for k in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS units", "2 AS sequence_id")
    after = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    whole = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t, *_ in rows]
    expected = Counter((r[0], len(ids)) for r, ids in zip(rows, whole))
    found = Counter()
    for r in after:
        found[r.doc_id, r.doc_tokens] += r.length
    assert found == Counter({k: n * k[1] for k, n in expected.items()})
    filled = {}
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def test_rows_without_id_are_spread(spark):
    docs = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, id) AS doc_id", "concat('text ', id) AS text", "'a' AS source"
    )
    crowd = _mixed(docs).groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert crowd < 10


def test_empty_documents(spark, tmp_path):
    empty = spark.createDataFrame([], f"{SCHEMA}, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
