"""Keyword searches over compacted days that open only files that may match."""

import re
from urllib.parse import unquote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frames import epoch, values
from logweir.functions.patterns import required_texts
from logweir.operators.filters import by_keywords
from logweir.sources import log_store, message_index
from logweir.sources.manifest import closed_days
from logweir.sources.message_index import needed_trigrams
from logweir.sources.storage import discard, new_path
from logweir.streaming.ingest import land_batch
from test_ingest import message, messages, payload

DAYS = [f"2024-02-{d:02d}T08:00:00Z" for d in range(1, 7)]
SPAN = (epoch(2024, 2, 1), epoch(2024, 2, 6))


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        ("disk full", [["disk full"]]),
        ("disk|net.*down", [["disk"], ["net", "down"]]),
        ("colou?r", [["colo", "r"]]),
        ("ab+c", [["ab", "c"]]),
        ("ab{0,2}c", [["a", "c"]]),
        (r"a\.b\d+c", [["a.b", "c"]]),
        ("x(yes|no)?z", [["x", "z"]]),
        ("x[a|b]z", [["x", "z"]]),
        ("a|", [["a"], []]),
        ("(?i)disk", None),
        (r"\Qa|b\E", None),
        (r"x\1", None),
        (r"\x41bc", None),
        ("[a[bc]]d", None),
        ("[]a]b", None),
        ("x(?i:y)z", None),
        ("", [[]]),
    ],
)
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == texts


def test_patterns_without_trigrams_are_not_looked_up():
    for pattern in ("", "ab", "error|no", "a.b.c.d", "(error)", None):
        assert needed_trigrams(pattern) is None
    assert needed_trigrams("err.r|fatal") is not None
    assert needed_trigrams(["a.b.", "xyz"], literal=True) == [[".b.", "a.b"], ["xyz"]]


PIECES = st.sampled_from(
    ["abc", "b", "c?", "d*", "e+", "f{0,1}", "g{2}", ".", "^", "$", "[ab]", "[^c]", "(ab|c)", "|"]
    + ["(?:d)?", "\\.", "\\d", "\\|", "c+?", "a??", "(x(y)|[)])", "(?!q)"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=6), st.text("abcdefgxy.|1)", max_size=12))
def test_a_match_holds_the_required_texts(pieces, text):
    pattern = "".join(pieces)
    try:
        found = re.search(pattern, text)
    except re.error:
        return
    texts = required_texts(pattern)
    if found and texts is not None:
        assert any(all(t in text for t in branch) for branch in texts)


@pytest.fixture
def root(spark):
    path = new_path(spark, "store")
    texts = [message("t", "p q+%", payload(f"line of {d[:10]} caf\u00e9", d)) for d in DAYS]
    texts.append(message("t", "p q+%", payload(None, DAYS[0])))
    land_batch(messages(spark, texts), path, "s", 0)
    log_store.compact_days(spark, path, f"{path}/compacted", SPAN[0], epoch(2024, 2, 4))
    return path


def found(spark, root, words, literal=False, span=SPAN):
    rows = log_store.read_logs(
        spark, root, f"{root}/compacted", span=span, keywords=words, literal=literal
    )
    texts = values(by_keywords(rows, words, literal=literal), "data.message")
    opened = {f for f in rows.inputFiles() if "/compacted/" in f}
    return len(opened), sorted(int(re.search(r"-(\d\d) ", t)[1]) for t in texts)


def test_only_files_that_may_match_are_opened(spark, root):
    everything = found(spark, root, "line")
    assert everything[1] == [1, 2, 3, 4, 5, 6]
    assert found(spark, root, "02-03|02-05") == (1, [3, 5])
    assert found(spark, root, ["2-01", "2-04 caf\u00e9"], literal=True) == (2, [1, 4])
    assert found(spark, root, "nowhere") == (0, [])
    assert found(spark, root, "[0-9]4 c")[1] == [4]
    assert found(spark, root, "02-0[3]")[1] == [3]
    one_day = (epoch(2024, 2, 2), epoch(2024, 2, 2))
    assert found(spark, root, "line of", span=one_day)[0] == 1


def test_days_compacted_again_and_without_index(spark, root):
    target = f"{root}/compacted"
    late = [message("t", "p q+%", payload("late of 2024-02-03 x", DAYS[2]))]
    land_batch(messages(spark, late), root, "s", 1)
    assert found(spark, root, "late of") == (0, [3])
    log_store.compact_days(spark, root, target, epoch(2024, 2, 3), epoch(2024, 2, 3))
    assert found(spark, root, "late of")[1] == [3]
    assert found(spark, root, "02-03")[1] == [3, 3]
    discard(spark, f"{target}/trigrams")
    assert found(spark, root, "02-03|02-01")[1] == [1, 3, 3]


def test_common_keywords_read_all_files(spark, root, monkeypatch):
    monkeypatch.setattr(message_index, "LISTED_FILES", 1)
    assert found(spark, root, "line of")[1] == [1, 2, 3, 4, 5, 6]
    assert found(spark, root, "02-03") == (1, [3])


def test_files_are_named_after_trigrams_are_combined(spark, root):
    (generation,) = [c.generation for c in closed_days(spark, f"{root}/compacted")]
    place = f"{root}/compacted/data/generation={generation}"
    stored = spark.read.schema(log_store.store_schema()).orc(place)
    rows = message_index.index_rows(stored, generation)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # A plan is printed from its last step to its first.
    assert re.match(r"Aggregate \[day#\d+, path#\d+, trigram#\d+\]", plan)
    assert plan.index("substring_index") < plan.index("Generate") < plan.index("make_date")
    expected = {
        (gram, unquote(path).split(f"/generation={generation}/")[1])
        for path, text in values(stored, "_metadata.file_path", "data.message")
        for gram in message_index.trigrams(text or "")
    }
    assert sorted(values(rows, "trigram", "file")) == sorted(expected)
