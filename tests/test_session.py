import pytest

from logweir.errors import ConfigurationError, ValidationError
from logweir.operators.histogram import duration
from logweir.session import TIME_ZONE, check_session, prepare
from logweir.sources import storage


class Session:
    """A session that only has settings."""

    def __init__(self, **settings):
        self.conf = {k.replace("__", "."): v for k, v in settings.items()}


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = Session(spark__master="spark://host:1", spark__checkpoint__dir="hdfs://c/dir/")
    assert storage.shared_dir(named) == "hdfs://c/dir"
    first, second = (storage.new_path(spark, "x") for _ in range(2))
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_cluster_without_one_is_refused():
    with pytest.raises(ConfigurationError):
        storage.shared_dir(Session(spark__master="yarn"))
    local = storage.shared_dir(Session(spark__master="local[2]"))
    assert local == storage.shared_dir(Session(spark__master="local[*]"))


def test_staged_table_is_removed_after_an_error(spark, monkeypatch):
    path = storage.new_path(spark, "x")
    monkeypatch.setattr(storage, "new_path", lambda *_: path)
    with pytest.raises(RuntimeError), storage.staged(spark.range(3)) as rows:
        assert rows.count() == 3 and storage.exists(spark, path)
        raise RuntimeError
    assert not storage.exists(spark, path)


def test_time_zone_is_pinned(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert prepare(spark).conf.get("spark.sql.session.timeZone") == TIME_ZONE


@pytest.mark.parametrize(
    ("key", "value"),
    [("spark.sql.session.timeZone", "Europe/Paris"), ("spark.sql.adaptive.enabled", "false")],
)
def test_writing_jobs_check_the_session(spark, key, value):
    before = spark.conf.get(key)
    check_session(spark)
    spark.conf.set(key, value)
    try:
        with pytest.raises(ConfigurationError):
            check_session(spark)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("window", ["1 month", "abc", "", "0 hours", "hour", "1 year", -1])
def test_windows_without_a_fixed_length_are_refused(window):
    with pytest.raises(ValidationError):
        duration(window)


@pytest.mark.parametrize("window", ["1 hour", "2 Days", "1 hour 30 minutes", 60, "60", "1week"])
def test_windows_of_a_fixed_length(window):
    assert duration(window)
