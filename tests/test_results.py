import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import epoch, log_rows, values
from logweir.errors import NotFoundError, ValidationError
from logweir.operators import parts
from logweir.operators.parts import part_metadata
from logweir.plans.browse import browse
from logweir.plans.log_query import HISTOGRAM, LOG_QUERY, LogQuery, run_all, run_log_query
from logweir.sources import result_store as store
from logweir.sources.storage import count_stored, exists, footers, new_path, staged


def numbered(spark, timestamps):
    """Rows with the given timestamps, in scrambled order."""
    rows = [(i, t) for i, t in enumerate(timestamps)]
    frame = spark.createDataFrame(rows, "row long, timestamp long")
    return frame.repartition(4)


def stored(spark, timestamps, rows_per_part=7):
    path = new_path(spark, "test")
    total = store.write_result(numbered(spark, timestamps), path, ("row",), rows_per_part)
    assert total == len(timestamps)
    return path


# Runs of equal timestamps, a gap, and ties that reach over part edges.
TIMESTAMPS = [None, None, *[10] * 25, *range(11, 40), *[50] * 20, 90, 90, 91]


@pytest.fixture(scope="module")
def path(spark):
    return stored(spark, TIMESTAMPS)


def test_parts_are_sorted_and_balanced(spark, path):
    metadata = values(
        store.part_index(spark, path).orderBy("part_id"),
        "startOffset",
        "endOffset",
        "startTimestamp",
        "endTimestamp",
        "partName",
    )
    assert len(metadata) > 5
    expected = 0
    last = -math.inf
    for start, end, low, high, name in metadata:
        assert start == expected and end >= start
        expected = end + 1
        if low is not None:
            assert last <= low <= high
            last = high
        assert name.startswith("part_id=")
    assert expected == len(TIMESTAMPS)
    # Many equal timestamps do not end up in one part.
    assert max(end - start for start, end, *_ in metadata) < 25


def test_whole_result_in_order(spark, path):
    rows = values(store.read_result(spark, path).orderBy("offset"), "offset", "row", "timestamp")
    assert rows == [(i + 1, i, t) for i, t in enumerate(TIMESTAMPS)]


@pytest.mark.parametrize("size", [1, 17, 33, 200])
def test_pages_make_up_the_result(spark, path, size):
    pages = []
    starts = range(1, len(TIMESTAMPS) + 1, size) if size > 1 else [1, 2, 7, 8, 30]
    for start in starts:
        page = store.offset_page(spark, path, start, start + size - 1)
        pages += values(page, "offset", "row")
    if size > 1:
        assert pages == [(i + 1, i) for i in range(len(TIMESTAMPS))]
    else:
        assert pages == [(s, s - 1) for s in starts]


def test_page_past_the_end_is_empty(spark, path):
    assert store.offset_page(spark, path, 1_000, 1_010).collect() == []
    assert values(store.offset_page(spark, path, len(TIMESTAMPS), 1_010), "row") == [
        len(TIMESTAMPS) - 1
    ]


@pytest.mark.parametrize(
    ("start", "end"), [(10, 10), (10, 50), (41, 49), (50, 91), (0, 9), (91, 99), (20, 25)]
)
def test_time_page(spark, path, start, end):
    inside = [i for i, t in enumerate(TIMESTAMPS) if t is not None and start <= t <= end]
    page = store.time_page(spark, path, start, end, 3, 14)
    assert page.total == len(inside)
    assert values(page.rows, "offset", "row") == [
        (n + 3, row) for n, row in enumerate(inside[2:14])
    ]
    if not inside:
        assert page.result_id == ""
        return
    again = store.slice_page(spark, path, page.result_id, 1, 1_000)
    assert values(again.rows, "row") == inside and again.total == len(inside)
    assert store.slice_page(spark, path, page.result_id, 900, 901).rows.collect() == []
    assert store.time_page(spark, path, start, end, 3, 14).result_id == page.result_id
    export, total = store.export_time_slice(spark, path, start, end, rows_per_chunk=4)
    assert total == len(inside)
    names = values(store.read_chunk_index(spark, path, export), "partName")
    assert all(exists(spark, f"{path}/slices/{export}/{name}") for name in names)
    chunks = spark.read.parquet(f"{path}/slices/{export}").groupBy("chunk_id").count()
    sizes = [n for _, n in sorted(values(chunks, "chunk_id", "count"))]
    assert sizes[:-1] == [4] * (len(sizes) - 1) and sum(sizes) == len(inside)


def test_missing_slice(spark, path):
    with pytest.raises(NotFoundError):
        store.slice_page(spark, path, "result_none", 1, 2)


def test_ranges_are_checked(spark, path):
    with pytest.raises(ValidationError):
        store.offset_page(spark, path, 5, 4)
    with pytest.raises(ValidationError):
        store.time_page(spark, path, 5, 4, 1, 2)
    with pytest.raises(ValidationError):
        store.export_time_slice(spark, path, 4, 5, rows_per_chunk=0)
    for page in (store.offset_page, lambda *a: store.time_page(*a[:2], 4, 5, *a[2:])):
        with pytest.raises(ValidationError):
            page(spark, path, 0, 4)
    with pytest.raises(ValidationError):
        store.write_result(numbered(spark, [1]), new_path(spark, "test"), rows_per_part=0)
    with pytest.raises(ValidationError):
        parts.overlapping_parts(store.part_index(spark, path), 1, 2, "Name")


def test_empty_result(spark):
    path = stored(spark, [])
    assert values(store.read_statistics(spark, path), "value") == [0]
    assert store.read_metadata(spark, path).collect() == []
    assert store.read_result(spark, path).collect() == []
    assert store.offset_page(spark, path, 1, 10).collect() == []
    page = store.time_page(spark, path, 0, 10, 1, 5)
    assert (page.total, page.result_id, page.rows.collect()) == (0, "", [])


def test_single_row(spark):
    path = stored(spark, [5])
    assert values(store.offset_page(spark, path, 1, 1), "row", "timestamp") == [(0, 5)]


def test_result_is_not_overwritten(spark, path):
    with pytest.raises(ValidationError, match="exists"):
        store.write_result(numbered(spark, [1]), path)


@pytest.mark.parametrize("step", ["part_metadata", "offset_index", "write_new"])
def test_a_result_is_there_as_a_whole_or_not_at_all(spark, monkeypatch, step):
    """A job that dies on the way leaves nothing that is read, or that stops the next one."""
    path = new_path(spark, "test")

    def dies(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, step, dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.write_result(numbered(spark, [3, 1, 2]), path)
    monkeypatch.undo()
    with pytest.raises(NotFoundError):
        store.offset_page(spark, path, 1, 3)
    with pytest.raises(NotFoundError):
        store.read_result(spark, path)
    assert values(store.read_statistics(spark, path), "value") == [0]
    assert store.write_result(numbered(spark, [3, 1, 2]), path) == 3
    assert values(store.offset_page(spark, path, 1, 3), "timestamp") == [1, 2, 3]


def test_pages_of_many_parts_are_joined_with_the_index(spark, path, monkeypatch):
    named = values(store.offset_page(spark, path, 2, 12), "row", "offset")
    monkeypatch.setattr(store, "LISTED_DIRECTORIES", 0)
    assert values(store.offset_page(spark, path, 2, 12), "row", "offset") == named


def test_identical_rows_spread_over_parts(spark):
    path = new_path(spark, "test")
    same = spark.range(60).select(F.lit("same").alias("message"), F.lit(7).alias("timestamp"))
    assert store.write_result(same, path, rows_per_part=10) == 60
    counts = values(store.read_metadata(spark, path), "count")
    assert sum(counts) == 60 and len(counts) == 6


def test_staged_tables_are_removed(spark, monkeypatch):
    made = []

    def recorded(session, label):
        made.append(new_path(session, label))
        return made[-1]

    monkeypatch.setattr("logweir.sources.storage.new_path", recorded)
    store.write_result(numbered(spark, [3, 1, 2]), new_path(spark, "test"))
    assert len(made) == 1 and not exists(spark, made[0])


def test_statistics_without_a_file(spark):
    missing = new_path(spark, "missing")
    assert values(store.read_statistics(spark, missing), "value") == [0]
    with pytest.raises(NotFoundError):
        store.read_metadata(spark, missing)
    assert store.read_job_statistics(spark, missing, LOG_QUERY).collect() == []
    with pytest.raises(NotFoundError):
        store.read_result(spark, missing)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(-5, 60), st.integers(0, 40), st.sampled_from(parts.MODES))
def test_overlap_is_interval_intersection(spark, start, length, mode):
    end = start + length
    bounds = [(0, 0, 3), (1, 4, 4), (2, 10, 20), (3, 20, 31), (4, None, None)]
    frame = spark.createDataFrame(bounds, f"part_id long, start{mode} long, end{mode} long")
    found = values(parts.overlapping_parts(frame, start, end, mode).orderBy("part_id"), "*")
    assert found == [
        (p, max(low, start), min(high, end))
        for p, low, high in bounds
        if low is not None and max(low, start) <= min(high, end)
    ]


ROWS = [
    ("2024-01-01 10:00:00", "error", "a 1"),
    ("2024-01-01 10:59:59.5", "error", "a 2"),
    ("2024-01-01 12:00:00", "error", "a 3"),
    ("2024-01-02 00:30:00", "info", "a 4"),
    ("2024-01-02 00:30:00", "error", "b 5"),
]
QUERY = LogQuery(epoch(2024, 1, 1), epoch(2024, 1, 2), "error", ["a"])


def test_run_all_and_browse(spark):
    root = new_path(spark, "jobs")
    paths = {t: f"{root}/j1_{t}" for t in (LOG_QUERY, HISTOGRAM)}
    counts = run_all(log_rows(spark, ROWS), QUERY, "1 hour", paths)
    assert counts == {LOG_QUERY: 3, HISTOGRAM: 2}

    whole = browse(spark, root, "j1", LOG_QUERY)
    assert whole.total == 3
    assert values(whole.rows, "time", "message") == [
        ("2024-01-01 10:00:00", "a 1"),
        ("2024-01-01 10:59:59.500000", "a 2"),
        ("2024-01-01 12:00:00", "a 3"),
    ]
    page = browse(spark, root, "j1", HISTOGRAM, "offset", start=1, end=9)
    # The empty hour from 11 to 12 is left out.
    assert values(page.rows, "start", "end", "count") == [
        ("2024-01-01 10:00:00", "2024-01-01 11:00:00", 2),
        ("2024-01-01 12:00:00", "2024-01-01 13:00:00", 1),
    ]
    timed = browse(
        spark,
        root,
        "j1",
        LOG_QUERY,
        "time",
        start=1,
        end=5,
        start_timestamp=epoch(2024, 1, 1, 10, 59),
        end_timestamp=epoch(2024, 1, 1, 12),
    )
    assert timed.total == 2 and values(timed.rows, "message") == ["a 2", "a 3"]
    saved = browse(
        spark, root, "j1", LOG_QUERY, "result", start=2, end=2, result_id=timed.result_id
    )
    assert values(saved.rows, "message") == ["a 3"] and saved.total == 2

    stats = store.read_job_statistics(spark, root, LOG_QUERY)
    assert values(stats, "jobId", "totalRowCount") == [("j1", 3)]


def test_histogram_alone(spark):
    path = new_path(spark, "jobs")
    assert run_all(log_rows(spark, ROWS), QUERY, 3600, {HISTOGRAM: path}) == {HISTOGRAM: 2}
    assert sorted(values(store.read_result(spark, path), "count")) == [1, 2]
    assert run_all(log_rows(spark, ROWS), QUERY, 3600, {}) == {}


def test_browse_checks_its_arguments(spark):
    for arguments in (
        ("Other", None),
        (LOG_QUERY, "page"),
        (LOG_QUERY, "offset"),
        (LOG_QUERY, "time"),
    ):
        with pytest.raises(ValidationError):
            browse(spark, "/nowhere", "j1", *arguments)
    with pytest.raises(ValidationError):
        browse(spark, "/nowhere", "j1", LOG_QUERY, "offset", start=3, end=2)


def test_number_of_parts_rounds_up(spark):
    path = new_path(spark, "test")
    rows = [(f"2024-01-01 00:00:{s:02d}", "error", "a") for s in range(30)]
    assert run_log_query(log_rows(spark, rows), QUERY, path, rows_per_part=20) == 30
    assert store.read_metadata(spark, path).count() == 2


def test_large_results_have_several_parts_in_a_range(spark, monkeypatch):
    """Half of the rows in one second; ranges are few, parts still have their size."""
    monkeypatch.setattr("logweir.operators.parts.MOST_RANGES", 4)
    timestamps = sorted([7] * 500 + [int(x**0.5) for x in range(500)])
    path = stored(spark, timestamps, 20)
    index = values(store.part_index(spark, path).orderBy("startOffset"), "part_id", "startOffset", "endOffset")
    assert len({p >> 17 for p, *_ in index}) == 4 and len(index) >= 50
    assert [p for p, *_ in index] == sorted(p for p, *_ in index)
    sizes = [end - start + 1 for _, start, end in index]
    assert max(sizes) <= 20 and sizes.count(20) >= len(sizes) - 4
    rows = values(store.read_result(spark, path).orderBy("offset"), "offset", "row", "timestamp")
    assert rows == [(i + 1, i, t) for i, t in enumerate(timestamps)]
    assert values(store.offset_page(spark, path, 395, 444), "row") == list(range(394, 444))
    assert store.time_page(spark, path, 7, 7, 1, 5).total == timestamps.count(7)


def test_ranges_of_skewed_times_stay_even(spark):
    timestamps = [5] * 6000 + list(range(6, 3006)) + [4000] * 3000
    path = stored(spark, timestamps, 1000)
    sizes = values(store.read_metadata(spark, path), "count")
    assert sum(sizes) == len(timestamps) and max(sizes) <= 2000


def test_figures_come_from_footers(spark):
    """No job reads staged rows to count, or the result to index."""
    frame = numbered(spark, TIMESTAMPS)
    with staged(store.with_sequence(frame), "test") as rows:
        assert count_stored(rows) == len(TIMESTAMPS)
    with staged(store.with_sequence(frame.limit(0)), "test") as rows:
        assert count_stored(rows) == 0
    path = stored(spark, TIMESTAMPS)
    commit = store.read_commit(spark, path)
    written = store._stored_rows(footers(spark), commit.base, commit.schema)
    plan = part_metadata(written)._jdf.queryExecution().executedPlan().toString()
    pushed = "PushedAggregation: [COUNT(*), MIN(timestamp), MAX(timestamp)]"
    assert pushed in plan and "PushedGroupBy: [part_id]" in plan
    # The session itself keeps its readers.
    assert "orc" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_a_result_stored_meanwhile_is_kept(spark, path, monkeypatch):
    monkeypatch.setattr(store, "check_absent", lambda *_: None)
    with pytest.raises(ValidationError):
        store.write_result(numbered(spark, [1, 2]), path, ("row",))
    assert store.read_result(spark, path).count() == len(TIMESTAMPS)
