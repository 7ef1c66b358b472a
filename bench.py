"""Times the reports and merges on one local session and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. The no-op
sink makes Spark produce every row without moving it to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shoplens.session import build_session
from shoplens.testbed.queries import run

HEADLINE = [
    "shop_funnel",
    "funnel_churn",
    "landing_page_conversion",
    "product_conversion",
    "product_conversion_by_tag",
    "conversion_table",
    "conversion_over_time",
    "experiment_summary",
    "sales_by_dimension",
    "sales_by_region",
    "sticky_assignment",
    "order_feed_flatten",
    "order_upsert",
    "stream_order_upsert",
    "stream_product_upsert",
    "stream_event_ingest",
    "cookie_dedup",
    "shop_funnel_union",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            run(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total median seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
