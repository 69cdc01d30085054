"""Runs the headline reads at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rowsmith.plans.inspect import scanned_rows
from rowsmith.queries import QUERIES
from rowsmith.session import get_session
from rowsmith.sources.parquet import footer

NAMES = (
    "full_scan", "full_lineitem", "project_1", "project_5", "project_10", "project_nested_list", "project_drop_list", "eq_int", "eq_str",
    "between_time", "in_int", "not_between", "where_multi", "flagship", "struct_list", "map_struct", "evolve_files", "ordered_read", "consumer_agg",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        best = float("inf")
        for _ in range(3):  # the first compiles code
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    lineitem = f"{sf_dir}/lineitem.parquet"
    total, groups = spark.read.parquet(lineitem).count(), sum(len(footer(spark, f).row_groups) for f in spark.read.parquet(lineitem).inputFiles())
    scanned = {name: round(scanned_rows(QUERIES[name](spark, sf_dir)) / total, 4) for name in ("full_lineitem", "flagship", "where_multi", "between_time")}
    full = took["full_lineitem"]
    ratios = {name: round(took[name] / full, 3) for name in ("project_1", "project_5", "project_10", "flagship", "where_multi")} | {"list_dropped": round(took["project_drop_list"] / took["project_nested_list"], 3)}
    spark.stop()
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "ratios_to_full": ratios, "scanned_of_lineitem": scanned, "lineitem_row_groups": groups, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
