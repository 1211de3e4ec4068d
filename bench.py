"""Times the headline queries: a warm-up and the median of three runs each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ["eq_categorical", "range_open_high", "range_closed", "eq_and_range", "between_pruned", "count_exact", "agg_all", "join_pruned", "group_having", "approx_aggregates", "count_upper_bound", "equi_depth", "pruning_lag", "dense_refinement"]
RUNS = 3


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from skiplane.plans import catalogue
    from skiplane.plans.predicate import Predicate

    queries, took = catalogue.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    events = catalogue._engine(spark, sf, "events").table("events")
    flags = {"events value >= 100": Predicate().between("value", low=100), "events error and value 100..500": Predicate().eq("event_type", "error").between("value", 100, 500)}
    pruning = {k: {"scanned": (r := events.report(p)).segments_scanned, "total": r.segments_total, "rows": events.read(p).count()} for k, p in flags.items()}
    layouts = {r["layout"]: {k: v for k, v in r.asDict().items() if k != "layout"} for r in queries["layout_bytes"](spark, sf).collect()}
    files = events.file_stats().first().asDict()
    print(json.dumps({"metric": "headline queries, median seconds summed", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf), "pruning": pruning, "events value >= 100 by layout": layouts, "events files": files}))


if __name__ == "__main__":
    main()
