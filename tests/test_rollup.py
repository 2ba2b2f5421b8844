"""Counts landed with the batches against a scan of the logs."""

import pytest

from frames import epoch, values
from logweir.operators.histogram import is_whole_minutes
from logweir.plans import log_query as plans
from logweir.plans.log_query import LogQuery, histogram_of_store, log_histogram
from logweir.sources import log_store, rollup
from logweir.sources.storage import new_path
from logweir.streaming import ingest
from logweir.streaming.ingest import land_batch
from test_ingest import message, messages, payload

SPAN = (epoch(2024, 2, 3), epoch(2024, 2, 4))
TIMES = ("2024-02-02T23:59:59Z", "2024-02-03T10:11:12Z", "2024-02-03T10:11:59.9Z", "2024-02-04T08:00:00Z", None)
ORIGINS = (("t", "p"), ("syslog", "linux"), ("ESLogs", "web"), (None, "p"))
TEXTS = [
    message(*origin, payload("x", time, level=level, _tag_appName=app))
    for origin in ORIGINS
    for time in TIMES
    for level, app in (("info", "a"), ("error", "b"), (None, None))
]


def landed(spark, *batches):
    root = new_path(spark, "store")
    for number, texts in enumerate(batches):
        land_batch(messages(spark, texts), root, "s", number)
    return root


def scanned(spark, root, query, window):
    return values(log_histogram(log_store.read_log_stores(spark, root), query, window))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def root(spark):
    return landed(spark, TEXTS, TEXTS[:30], ["garbage"])


@pytest.mark.parametrize(
    "query",
    [
        LogQuery(*SPAN),
        LogQuery(*SPAN, "ERROR"),
        LogQuery(*SPAN, app_name="a", plugin="web"),
        LogQuery(*SPAN, doc_type="syslog"),
        LogQuery(epoch(2023, 1, 1), epoch(2023, 1, 1)),
    ],
)
@pytest.mark.parametrize("window", ["1 minute", "1 day 2 hours"])
def test_counts_answer_as_a_scan_does(spark, root, query, window):
    found = histogram_of_store(spark, root, query, window)
    assert "message" not in plan_of(found)
    assert values(found) == scanned(spark, root, query, window)


def test_what_counts_cannot_answer_is_scanned(spark, root):
    for query, window in ((LogQuery(*SPAN, keywords=["x"]), 3600), (LogQuery(*SPAN), "30 seconds")):
        found = histogram_of_store(spark, root, query, window)
        assert values(found) == scanned(spark, root, query, window) != []


def test_replayed_and_lost_batches(spark, monkeypatch):
    root = landed(spark, TEXTS)
    query = LogQuery(*SPAN)
    before = values(histogram_of_store(spark, root, query, 60))
    again = land_batch(messages(spark, TEXTS), root, "s", 0)
    assert rollup.ROLLUP not in again and again["dead_letter"] == 15
    monkeypatch.setattr(ingest, "commit_batch", lambda *_: None)
    land_batch(messages(spark, TEXTS), root, "s", 1)
    assert values(histogram_of_store(spark, root, query, 60)) == before
    monkeypatch.undo()
    land_batch(messages(spark, TEXTS), root, "s", 1)
    twice = [(a, b, 2 * n, t) for a, b, n, t in before]
    assert values(histogram_of_store(spark, root, query, 60)) == twice


def test_batches_without_counts_are_scanned(spark, monkeypatch):
    """As batches that an earlier version landed."""
    commit = ingest.commit_batch

    def without(spark, root, stream_id, batch_id, facts):
        commit(spark, root, stream_id, batch_id, {k: v for k, v in facts.items() if k != rollup.ROLLUP})

    monkeypatch.setattr(ingest, "commit_batch", without)
    root = landed(spark, TEXTS)
    monkeypatch.undo()
    land_batch(messages(spark, TEXTS), root, "s", 1)
    assert rollup.read_rollup(spark, root, SPAN) is None
    assert values(plans.histogram_of_store(spark, root, LogQuery(*SPAN), 60)) == scanned(
        spark, root, LogQuery(*SPAN), 60
    )


def test_whole_minutes():
    assert all(map(is_whole_minutes, (60, "120", "1 hour", "2 weeks", "1 minute 60 seconds")))
    assert not any(map(is_whole_minutes, (59, "90 seconds", "100 milliseconds", "1 day 1 second")))
