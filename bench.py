"""Timings as one JSON line: the queries at $BENCH_SF_DIR, then bulk insert, weight and lookup of all keys at 2^30 bits."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from bitsieve import Filter, queries
from bitsieve.session import local_session
from bitsieve.sources.measures import sequence

NAMES = ("flat_weight_orders", "flat_probe_lineitem", "flat_probe_join", "blocked_weight", "blocked_probe", "blocked_probe_join", "sharded_weight", "sharded_probe", "sharded_probe_join", "fpr_flat", "approx_semi_join", "exact_semi_join", "merge_equals_union", "perf_report_join", "flat_probe_chunks", "blocked_probe_chunks", "sharded_probe_chunks")
#: Keys, and the power of two of the filter's bits: those of the published measurements' first row.
BULK, SIZE2 = int(os.environ.get("BENCH_ITEMS", 10_000_000)), int(os.environ.get("BENCH_SIZE2", 30))


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    all_queries, took = queries.catalogue(), {}

    def timed(name: str, f) -> None:
        f()
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            f()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)

    for name in NAMES if not os.environ.get("BENCH_BULK_ONLY") else ():
        timed(name, lambda q=all_queries[name][0]: q(spark, d).write.format("noop").mode("overwrite").save())
    fprs = {}
    for variant in ("SYNC_BASIC", "SYNC_CACHE", "PIM"):
        f = Filter.create(spark, variant, SIZE2, 8)
        items = sequence(spark, BULK)
        # Probed in an order of their own, made beforehand.
        probes = items.orderBy(F.xxhash64("item")).persist()
        probes.count()

        def once(name: str, action) -> None:
            began = time.perf_counter()
            action()
            took[f"{name}_{BULK}_{variant}_2^{SIZE2}"] = round(time.perf_counter() - began, 3)

        full = f.insert_bulk(items).persist()
        once("insert", full.words.count)
        once("weight", full.weight)
        for strategy in ("chunks", "join"):
            once(f"lookup_{strategy}", lambda: full.contains_bulk(probes, strategy=strategy).write.format("noop").mode("overwrite").save())
        fprs[variant] = full.fpr(sequence(spark, 100_000, BULK))
        full.unpersist()
        probes.unpersist()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.get(n, 0.0) for n in NAMES), 3), "unit": "sec", "queries": took, "fpr": fprs, "sf": d, "cores": spark.sparkContext.defaultParallelism}))


if __name__ == "__main__":
    main()
