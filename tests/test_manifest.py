"""Batches seen whole, and compacted days read together with open ones."""

import re
from datetime import date

import pytest

from frames import epoch, values
from logweir.errors import NotFoundError
from logweir.plans.log_query import LogQuery, log_query
from logweir.sources import log_store, manifest
from logweir.sources.layouts import STANDARD_STRATEGY
from logweir.sources.storage import new_path
from logweir.streaming import ingest
from logweir.streaming.ingest import land_batch
from test_ingest import message, messages, payload

DAYS = [f"2024-02-{d:02d}T08:00:00Z" for d in range(1, 7)]
ORIGINS = [("t", "p"), ("syslog", "linux"), ("ESLogs", "web")]
WHOLE = (epoch(2024, 1, 1), epoch(2024, 12, 31))


def texts_of(days, note="", origins=ORIGINS):
    return [message(*o, payload(f"{note}{o[0]} {d[:10]}", d)) for d in days for o in origins]


def land(spark, root, batch, texts, stream="s"):
    return land_batch(messages(spark, texts), root, stream, batch)


@pytest.fixture
def root(spark):
    path = new_path(spark, "store")
    timeless = message("t", "p", payload("timeless", None))
    land(spark, path, 0, [*texts_of(DAYS), timeless])
    return path


def landed(spark, root, target, span=None):
    rows = log_store.read_logs(spark, root, target, span=span)
    found = rows if span is None else log_query(rows, LogQuery(*span)).selectExpr("struct(*) data")
    return sorted(values(found, "data.message"))


def names(days, note="", origins=ORIGINS):
    return sorted(f"{note}{o[0]} {d[:10]}" for d in days for o in origins)


def test_every_row_is_read_once(spark, root):
    target = f"{root}/compacted"
    every = [*names(DAYS), "timeless"]
    assert landed(spark, root, target) == sorted(every)
    log_store.compact_days(spark, root, target, epoch(2024, 2, 1), epoch(2024, 2, 3))
    assert landed(spark, root, target) == sorted(every)
    # A late batch for a closed day and an open one, and one of another stream.
    land(spark, root, 1, texts_of([DAYS[0], DAYS[4]], "late "))
    land(spark, root, 0, texts_of([DAYS[1]], "other "), "r")
    every += names([DAYS[0], DAYS[4]], "late ") + names([DAYS[1]], "other ")
    assert landed(spark, root, target) == sorted(every)
    one = (epoch(2024, 2, 1), epoch(2024, 2, 1, 23))
    assert landed(spark, root, target, one) == sorted(
        names(DAYS[:1]) + names(DAYS[:1], "late ")
    )
    # Closing some days again, with others, takes the late rows in.
    log_store.compact_days(spark, root, target, epoch(2024, 2, 1), epoch(2024, 2, 5))
    assert landed(spark, root, target) == sorted(every)
    log_store.compact_days(spark, root, target, epoch(2024, 2, 2), epoch(2024, 2, 2))
    assert landed(spark, root, target) == sorted(every)
    log_store.compact_days(spark, root, target, *WHOLE)
    assert landed(spark, root, target) == sorted(every)
    assert log_store.read_compacted(spark, target).count() == len(every) - 1


def test_closed_days_open_no_batch(spark, root):
    target = f"{root}/compacted"
    span = (epoch(2024, 2, 1), epoch(2024, 2, 3))
    log_store.compact_days(spark, root, target, *span)
    land(spark, root, 1, texts_of(DAYS[4:]))
    closed = log_store.read_logs(spark, root, target, span=span)
    files = [f for f in closed.inputFiles()]
    assert files and all("/compacted/data/" in f for f in files)
    plan = closed._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"logs/(syslog|default|ESLogs)", plan)
    # A late batch opens no file of the batches the days have taken in.
    land(spark, root, 2, texts_of([DAYS[1]], "late "))
    late = log_store.read_logs(spark, root, target, span=span)
    batches = {
        f"batch {n}"
        for f in values(late.selectExpr("input_file_name()"))
        for n in re.findall(r"batch_id=(\d+)", f)
    }
    assert batches == {"batch 2"}


def test_days_of_one_generation_stay_with_it(spark, root):
    target = f"{root}/compacted"
    log_store.compact_days(spark, root, target, *WHOLE)
    log_store.compact_days(spark, root, target, epoch(2024, 2, 2), epoch(2024, 2, 2))
    closed = manifest.closed_days(spark, target)
    assert [(c.first, c.last, c.whole) for c in closed] == [
        (date(2024, 1, 1), date(2024, 2, 1), False),
        (date(2024, 2, 3), date(2024, 12, 31), False),
        (date(2024, 2, 2), date(2024, 2, 2), True),
    ]
    assert len({c.generation for c in closed}) == 2


def test_batches_after_a_missing_one_stay_open(spark, root):
    target = f"{root}/compacted"
    land(spark, root, 2, texts_of(DAYS[:1], "later "))
    assert manifest.closed_batches(manifest.read_commits(spark, root)) == {"s": 0}
    log_store.compact_days(spark, root, target, *WHOLE)
    land(spark, root, 1, texts_of(DAYS[:1], "between "))
    every = [*names(DAYS), "timeless", *names(DAYS[:1], "later "), *names(DAYS[:1], "between ")]
    assert landed(spark, root, target) == sorted(every)
    log_store.compact_days(spark, root, target, *WHOLE)
    assert landed(spark, root, target) == sorted(every)


def test_a_failed_batch_is_not_seen(spark, root, monkeypatch):
    before = sorted(values(log_store.read_log_stores(spark, root), "data.message"))
    write = ingest.write_batch

    def failing(rows, base, *where):
        if base.endswith("syslog"):
            raise RuntimeError("lost")
        write(rows, base, *where)

    texts = [*texts_of(DAYS[:2], "new "), "garbage"]
    monkeypatch.setattr(ingest, "write_batch", failing)
    with pytest.raises(RuntimeError):
        land(spark, root, 1, texts)
    assert sorted(values(log_store.read_log_stores(spark, root), "data.message")) == before
    assert log_store.read_dead_letters(spark, root).count() == 0
    with pytest.raises(NotFoundError):
        manifest.read_commits(spark, f"{root}/elsewhere")
    monkeypatch.setattr(ingest, "write_batch", write)
    counts = land(spark, root, 1, texts)
    assert counts == {"default": 2, "syslog": 2, "ESLogs": 2, "dead_letter": 1}
    after = sorted(values(log_store.read_log_stores(spark, root), "data.message"))
    assert after == sorted(before + names(DAYS[:2], "new "))
    # What has landed is not landed again, whatever it holds.
    assert land(spark, root, 1, ["garbage"]) == counts
    assert log_store.read_dead_letters(spark, root).count() == 1


def test_empty_batches_land_too(spark, root):
    assert land(spark, root, 1, []) == {}
    assert manifest.closed_batches(manifest.read_commits(spark, root)) == {"s": 1}
    assert landed(spark, root, f"{root}/none") == sorted([*names(DAYS), "timeless"])


def test_many_ranges_are_joined(spark, monkeypatch):
    root = new_path(spark, "store")
    for batch in (0, 2, 4):
        land(spark, root, batch, texts_of(DAYS[:1], f"{batch} ", ORIGINS[:1]))
    write = log_store.write_batch
    rows = log_store.read_log_store(spark, root)
    write(rows, log_store.layout_root(root, "default"), "s", 3, STANDARD_STRATEGY.default)
    wanted = [f"{b} t 2024-02-01" for b in (0, 2, 4)]
    assert sorted(values(log_store.read_log_store(spark, root), "data.message")) == wanted
    monkeypatch.setattr(manifest, "LISTED_RANGES", 1)
    assert sorted(values(log_store.read_log_store(spark, root), "data.message")) == wanted


def test_runs_of_days():
    days = [date(2024, 2, 28), date(2024, 3, 1), date(2024, 2, 29), date(2024, 5, 1)]
    assert manifest.runs_of(days) == [
        (date(2024, 2, 28), date(2024, 3, 1)),
        (date(2024, 5, 1), date(2024, 5, 1)),
    ]
