"""Wall-clock of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("q1_pricing_summary", "q3_shipping_priority", "q5_nation_revenue", "q6_forecast_revenue")
OTHERS = ("agg_group_count_distinct", "join_post_filter_or", "sort_mixed", "topk", "index_range", "index_loop_join")


def main() -> None:
    from pyspark.sql import SparkSession

    from slatewing.plans.queries import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as own:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{own}/shared").config("spark.local.dir", own).config("spark.sql.warehouse.dir", f"{own}/warehouse").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        cold, warm = {}, {}
        for name in (*HEADLINE, *OTHERS):
            times = []
            for _ in range(4):
                began = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - began)
            cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
        spark.stop()
    total = round(sum(warm[x] for x in HEADLINE), 3)
    print(json.dumps({"metric": "headline_warm_total", "value": total, "unit": "sec", "queries": warm, "cold": cold, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
