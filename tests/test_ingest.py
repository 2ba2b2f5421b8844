import json
from glob import glob

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from checks import views
from frames import epoch, values
from logweir.errors import NotFoundError, ValidationError
from logweir.operators import parse
from logweir.plans.log_query import LogQuery, log_query
from logweir.schemas import DEFAULT_PAYLOAD, YARN_PAYLOAD, merged_payload, registered_schemas
from logweir.sources import log_store
from logweir.sources.kafka import read_topic
from logweir.sources.layouts import PARTITION_CONFIG, STANDARD_STRATEGY, PartitionStrategy
from logweir.sources.storage import exists, new_path
from logweir.streaming import ingest
from logweir.streaming.ingest import land_batch, start_ingest


def message(doc_type="t", plugin="p", payload=None, encoded=True):
    body = {"message": json.dumps(payload) if encoded and payload is not None else payload}
    if doc_type is not None:
        body["_documentType"] = doc_type
    if plugin is not None:
        body["_plugin"] = plugin
    return json.dumps(body)


def payload(text, time="2024-02-03T10:11:12Z", **fields):
    return {"message": text, "time": time, "level": "info", **fields}


def messages(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    return frame.select(F.col("value").cast("binary").alias("value"))


TEXTS = [
    "garbage",
    None,
    message(None, "p", payload("no type")),
    message("t", None, payload("no plugin")),
    message("t", "it's", payload("quoted plugin")),
    message("t", "p", payload("encoded", node="n1")),
    message("t", "p", payload("nested", node="n2"), encoded=False),
    message("t", "p", payload("own origin", _documentType="inner", _plugin="q")),
    message("syslog", "linux", payload("from syslog")),
    message("ESLogs", "web", payload("from es")),
    message("t", "p", "not a struct", encoded=False),
    message("t", "p", None),
]


def land(spark, texts, **options):
    root = new_path(spark, "store")
    counts = land_batch(messages(spark, texts), root, "s1", 0, **options)
    return root, counts


def test_batch_is_split_by_layout(spark):
    root, counts = land(spark, TEXTS)
    assert counts == {"default": 6, "syslog": 1, "ESLogs": 1, "dead_letter": 4, "malformed": 1}
    landed = values(
        log_store.read_log_stores(spark, root),
        "data.message",
        "data.node",
        "_documentType",
        "_plugin",
        "year",
        "month",
        "day",
    )
    day = (2024, 2, 3)
    assert sorted(landed, key=str) == sorted(
        [
            ("quoted plugin", None, "t", "it's", *day),
            ("encoded", "n1", "t", "p", *day),
            ("nested", "n2", "t", "p", *day),
            ("own origin", None, "inner", "q", *day),
            ("from syslog", None, "syslog", "linux", *day),
            ("from es", None, "ESLogs", "web", *day),
            # A payload that cannot be read keeps the origin of its envelope.
            (None, None, "t", "p", None, None, None),
            (None, None, "t", "p", None, None, None),
        ],
        key=str,
    )


def test_dead_letters_keep_the_message(spark):
    root, _ = land(spark, TEXTS)
    dead = values(log_store.read_dead_letters(spark, root), "_raw", "_documentType", "_plugin")
    assert sorted(dead, key=str) == sorted(
        [
            (TEXTS[0], None, None),
            (None, None, None),
            (TEXTS[2], None, "p"),
            (TEXTS[3], "t", None),
            ("not a struct", "t", "p"),
        ],
        key=str,
    )
    assert log_store.read_dead_letters(spark, new_path(spark, "none")).collect() == []


@pytest.mark.parametrize(
    ("time", "expected"),
    [
        ("2020-01-01T00:00:00Z", epoch(2020, 1, 1)),
        ("2020-01-01T01:00:00+01:00", epoch(2020, 1, 1)),
        ("2020-01-01 10:11:12", epoch(2020, 1, 1, 10, 11, 12)),
        (1577836800, epoch(2020, 1, 1)),
        ("1577836800", None),
        ("yesterday", None),
        (None, None),
    ],
)
def test_event_times(spark, time, expected):
    rows = parse.decode_envelope(messages(spark, [message(payload=payload("x", time))]))
    logs = parse.typed_logs(rows, {})
    assert values(logs, F.col("_time").cast("long"), "data.message") == [(expected, "x")]


def test_layout_directories(spark):
    root, _ = land(spark, TEXTS)
    for layout, levels in STANDARD_STRATEGY.layouts.items():
        base = log_store.layout_root(root, layout)
        files = glob(f"{base}/**/*.orc", recursive=True)
        pattern = "/".join(f"{name}=*" for name in (*levels, *log_store.BATCH))
        assert files and sorted(files) == sorted(glob(f"{base}/{pattern}/*.orc"))


def test_landing_again_replaces_the_batch(spark):
    root, _ = land(spark, TEXTS)
    land_batch(messages(spark, TEXTS), root, "s1", 0)
    assert log_store.read_log_stores(spark, root).count() == 8
    assert log_store.read_dead_letters(spark, root).count() == 5
    # Another batch, and the same batch number of another stream, add to it.
    land_batch(messages(spark, TEXTS[4:6]), root, "s1", 1)
    land_batch(messages(spark, TEXTS[4:6]), root, "s2", 0)
    assert log_store.read_log_stores(spark, root).count() == 12


def test_yarn_rows_and_others_share_a_dataset(spark):
    schemas = registered_schemas(yarn_key="yarn.node")
    yarn = payload("container up", yarnContainer="c1", pid="7")
    texts = [message("yarn", "node", yarn), message("t", "p", payload("plain", pid="8"))]
    texts.append(message("t", "p", payload("stray", yarnContainer="c2")))
    root, _ = land(spark, texts, schemas=schemas)
    rows = log_store.read_log_store(spark, root, payload=merged_payload(schemas))
    found = values(rows, "data.message", "data.pid", "data.yarnContainer")
    assert sorted(found) == [
        ("container up", None, "c1"),
        ("plain", "8", None),
        ("stray", None, None),
    ]
    # A payload that is missing altogether stays a null struct.
    decoded = parse.decode_envelope(messages(spark, [message("t", "p", None)]))
    assert values(parse.parse_payload(decoded, schemas), "data") == [None]


def test_schema_registered_later(spark):
    """Files written before a schema was registered read as if it had been known."""
    root = new_path(spark, "store")
    yarn = message("yarn", "node", payload("up", yarnContainer="c1"))
    schemas = registered_schemas(yarn_key="yarn.node")
    land_batch(messages(spark, [yarn]), root, "s", 0)
    land_batch(messages(spark, [yarn]), root, "s", 1, schemas=schemas)
    new = log_store.read_log_store(spark, root, payload=merged_payload(schemas))
    assert sorted(values(new, "data.message", "data.yarnContainer"), key=str) == [
        ("up", "c1"),
        ("up", None),
    ]
    old = log_store.read_log_store(spark, root)
    assert values(old, "data.message") == ["up", "up"]
    assert "yarnContainer" not in old.schema["data"].dataType.fieldNames()


def test_fixed_strategy_has_one_layout(spark):
    fixed = PartitionStrategy.from_config({**PARTITION_CONFIG, "partitionStrategy": "fixed"})
    root, counts = land(spark, TEXTS, strategy=fixed)
    assert counts == {"default": 8, "dead_letter": 4, "malformed": 1}
    assert log_store.read_log_stores(spark, root, fixed).count() == 8


def test_stream_resumes_and_matches_the_batch(spark):
    root = new_path(spark, "stream")
    topic = f"{root}/topic"

    def send(texts):
        messages(spark, texts).coalesce(1).write.mode("append").parquet(topic)

    landed = {}

    def drain():
        stream = spark.readStream.schema("value binary").parquet(topic)
        query = start_ingest(
            stream,
            f"{root}/store",
            f"{root}/check",
            available_now=True,
            on_landed=landed.__setitem__,
        )
        query.awaitTermination()

    send(TEXTS[:6])
    drain()
    send(TEXTS[6:])
    drain()
    batch_root, _ = land(spark, TEXTS)
    columns = ("data.message", "_documentType", "_plugin", "day")
    assert sorted(
        values(log_store.read_log_stores(spark, f"{root}/store"), *columns), key=str
    ) == sorted(values(log_store.read_log_stores(spark, batch_root), *columns), key=str)

    assert landed[0] == {"default": 2, "dead_letter": 4}
    assert landed[1] == {"default": 4, "syslog": 1, "ESLogs": 1, "malformed": 1}

    # A new checkpoint replays everything under an id of its own.
    stream = spark.readStream.schema("value binary").parquet(topic)
    start_ingest(stream, f"{root}/store", f"{root}/other", available_now=True).awaitTermination()
    assert log_store.read_log_stores(spark, f"{root}/store").count() == 16


def test_batch_that_fails_half_way_is_replaced(spark, monkeypatch):
    root = new_path(spark, "stream")
    messages(spark, TEXTS).write.parquet(f"{root}/topic")

    def start(**trigger):
        stream = spark.readStream.schema("value binary").parquet(f"{root}/topic")
        return start_ingest(stream, f"{root}/store", f"{root}/check", **trigger)

    write = ingest.write_batch
    written = []

    def failing(rows, base, *where):
        if base.endswith("syslog"):
            raise RuntimeError("lost")
        write(rows, base, *where)
        written.append(base)

    monkeypatch.setattr(ingest, "write_batch", failing)
    with pytest.raises(StreamingQueryException):
        start(available_now=True).awaitTermination()
    assert written
    monkeypatch.setattr(ingest, "write_batch", write)
    query = start()
    query.processAllAvailable()
    query.stop()
    assert log_store.read_log_stores(spark, f"{root}/store").count() == 8
    assert log_store.read_dead_letters(spark, f"{root}/store").count() == 5


def test_crowded_partition_is_split(spark):
    """A day of one kind of log that holds most rows is written by several tasks."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 5 == 0, "rare").otherwise("busy").alias("kind"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    body = F.struct(F.col("text").alias("message"), F.lit("2024-02-03T00:00:00Z").alias("time"))
    envelope = F.struct(
        F.col("kind").alias("_documentType"), F.lit("p").alias("_plugin"), body.alias("message")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        root = new_path(spark, "store")
        land_batch(rows.select(F.to_json(envelope).alias("value")), root, "s", 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    logs = log_store.read_log_store(spark, root)
    assert logs.count() == 60_000
    files = [f for f in logs.inputFiles() if "busy" in f]
    assert len(files) > 2


def test_query_and_compaction_of_a_store(spark):
    days = [f"2024-0{m}-{d:02d}T08:00:00Z" for m, d in [(1, 31), (2, 1), (2, 2), (3, 1)]]
    origins = [("t", "p"), ("syslog", "linux"), ("ESLogs", "web")]
    texts = [message(*origin, payload(day, day)) for day in days for origin in origins]
    texts.append(message("t", "p", payload("timeless", None)))
    root, _ = land(spark, texts)
    span = (epoch(2024, 1, 31, 12), epoch(2024, 2, 1))
    found = log_query(log_store.read_log_stores(spark, root, span=span), LogQuery(*span))
    expected = sorted(day for day in days[:2] for _ in origins)
    assert values(found, "message") == expected

    target = f"{root}/compacted"
    whole = (epoch(2024, 1, 1), epoch(2024, 12, 31))
    log_store.compact_days(spark, root, target, *whole)
    late = message("t", "p", payload("late", days[1]))
    land_batch(messages(spark, [late]), root, "s1", 1)
    log_store.compact_days(spark, root, target, epoch(2024, 2, 1), epoch(2024, 2, 1))
    compacted = log_store.read_compacted(spark, target, span=span)
    assert sorted(values(log_query(compacted, LogQuery(*span)), "message")) == sorted(
        [*expected, "late"]
    )
    assert log_store.read_compacted(spark, target).count() == 13
    none = (epoch(1999, 1, 1), epoch(1999, 1, 2))
    assert log_store.read_compacted(spark, target, span=none).collect() == []


def test_missing_stores(spark):
    nowhere = new_path(spark, "none")
    for read in (log_store.read_log_store, log_store.read_log_stores, log_store.read_compacted):
        with pytest.raises(NotFoundError):
            read(spark, nowhere)
    assert not exists(spark, nowhere)


def test_partition_strategy():
    assert STANDARD_STRATEGY.layouts["syslog"] == ("_documentType", "_plugin")
    fixed = PartitionStrategy.from_config({**PARTITION_CONFIG, "partitionStrategy": "fixed"})
    assert list(fixed.layouts) == ["default"]
    with pytest.raises(ValidationError):
        PartitionStrategy(default=("host",))
    with pytest.raises(ValidationError):
        PartitionStrategy(default=("year",), pivot="level")
    with pytest.raises(ValidationError):
        PartitionStrategy(default=("year",), by_value={"default": ("year",)})


def test_schemas_must_agree_on_types():
    other = DEFAULT_PAYLOAD.fromJson(json.loads(YARN_PAYLOAD.json().replace("timestamp", "long")))
    with pytest.raises(ValidationError):
        merged_payload({"a.b": other})


def test_split_by_route(spark):
    rows = parse.decode_envelope(messages(spark, TEXTS))
    branches, rest = parse.split_by_route(rows, ["syslog.linux", "t.it's"])
    assert {key: branch.count() for key, branch in branches.items()} == {
        "syslog.linux": 1,
        "t.it's": 1,
    }
    assert rest.count() == 6
    assert parse.split_by_route(rows, [])[1].count() == 8


def test_topic_needs_the_connector(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException, match="kafka"):
        read_topic(spark, "broker:9092", "logs", 1000)


def test_a_parsed_payload_is_not_held_as_text_too(spark, monkeypatch):
    held = []
    frames = type(spark.range(0))
    persist = frames.persist

    def kept(frame, *level):
        held.append(values(frame, "_raw", "_malformed"))
        assert "_message" not in frame.columns
        return persist(frame, *level)

    monkeypatch.setattr(frames, "persist", kept)
    root, _ = land(spark, TEXTS)
    assert len(held) == 1
    texts = [t for rows in held for t, _ in rows if t is not None]
    assert sorted(texts) == sorted([TEXTS[0], TEXTS[2], TEXTS[3], "not a struct"])
    assert log_store.read_dead_letters(spark, root).count() == 5


def test_messages_of_a_table_are_built_by_several_tasks(spark, tmp_path, monkeypatch):
    events = spark.range(1_000).selectExpr(
        "id as event_id",
        "timestamp_seconds(1704844800 + id) as ts",
        "id % 7 as user_id",
        "if(id % 3 = 0, 'error', 'view') as event_type",
        "1.0D as value",
        "concat('k ', id) as props",
    )
    # One file with one group of rows, which no reader splits.
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = values(views.envelopes(spark, str(tmp_path)), F.col("value").cast("string"))
    monkeypatch.setattr(views, "EVENTS_PER_TASK", 100, raising=False)
    dealt = views.envelopes(spark, str(tmp_path))
    assert sorted(values(dealt, F.col("value").cast("string"))) == sorted(whole)
    sizes = values(dealt.groupBy(F.spark_partition_id()).count(), "count")
    assert len(sizes) == 10 and max(sizes) < 200
