"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries, views  # noqa: E402
from logweir.operators import catalog, filters, parse  # noqa: E402
from logweir.plans import log_query as logs_plan  # noqa: E402
from logweir.schemas import registered_schemas  # noqa: E402
from logweir.session import local_session  # noqa: E402
from logweir.sources import log_store, result_store  # noqa: E402
from logweir.sources.storage import new_path  # noqa: E402
from logweir.streaming.ingest import land_batch  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
SHIPMENT_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int = RUNS) -> float:
    """Best of several runs."""
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - start)
    return round(best, 4)


def main() -> None:
    spark = local_session(CPUS, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def lazy(name, df_of) -> None:
        seconds[name] = timed(lambda: materialise(df_of()))

    registered = queries.all_queries()
    for name in (
        "log_query",
        "histogram_by_day",
        "keyword_regex",
        "keyword_literal",
        "calendar_range_cross_year",
        "signature_search",
        "signature_page",
        "job_listing",
    ):
        lazy(name, lambda name=name: registered[name](spark, SF_DIR))

    topic = new_path(spark, "bench")
    views.envelopes(spark, SF_DIR).repartition(8).write.parquet(topic)
    messages = spark.read.schema("value binary").parquet(topic)

    def routed():
        rows = parse.decode_envelope(messages)
        return parse.typed_logs(rows.filter(parse.is_routable()), registered_schemas())

    lazy("routed_parse", routed)

    shipments = views.shipments(spark, SF_DIR)
    lazy("global_sort", lambda: shipments.orderBy("timestamp", *SHIPMENT_TIES))
    stored = []

    def store() -> None:
        stored.append(new_path(spark, "bench"))
        result_store.write_result(shipments, stored[-1], SHIPMENT_TIES, 100_000)

    seconds["store_result"] = timed(store)
    path = stored[-1]
    lazy("offset_page", lambda: result_store.offset_page(spark, path, 250_001, 251_000))
    lazy("whole_result", lambda: result_store.read_result(spark, path))
    first = 883_612_800  # 1998-01-01
    month = (first, first + 30 * 86_400)
    lazy("time_page", lambda: result_store.time_page(spark, path, *month, 1, 1_000).rows)
    slice_id, _ = result_store.save_time_slice(spark, path, *month)
    lazy("slice_page", lambda: result_store.slice_page(spark, path, slice_id, 1, 500).rows)

    roots = []

    def land() -> None:
        roots.append(new_path(spark, "bench"))
        land_batch(messages, roots[-1], "bench", 0)

    seconds["ingest_batch"] = timed(land, 2)
    span = (queries.START, queries.END)
    lazy(
        "store_log_query",
        lambda: logs_plan.log_query(
            log_store.read_log_stores(spark, roots[-1], span=span), queries.SEARCH
        ),
    )
    signatures = catalog.decode_signatures(views.raw_signatures(spark, SF_DIR))
    lazy("signature_listing", lambda: catalog.search_signatures(signatures))
    lazy("level_filter", lambda: filters.by_level(views.logs(spark, SF_DIR), "error"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(SF_DIR).name.removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
