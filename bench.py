"""Headline queries at one scale; prints one JSON line.

Every result is written out whole (`noop`), so no column is pruned away. Each query runs three
times in a row and the best run counts; the sum is the metric.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from contract.queries import QUERIES

HEADLINE = [
    "dedupe_latest",
    "dedupe_latest_ties",
    "scd2_stage",
    "scd2_merge_step",
    "scd2_history_events",
    "scd2_history_orders",
    "scd2_history_lineitem",
    "scd2_history_hot_keys",
    "gold_customer_daily",
    "gold_partition_overwrite",
    "cdc_to_json",
    "cdc_parse_json",
    "cdc_rejects",
    "cdc_generate",
    "incremental_read",
    "bronze_by_day",
    "bronze_stream_ingest",
    "scd2_incremental",
    "medallion_end_to_end",
]
REPEATS = 3


def session(cpus: str) -> SparkSession:
    base = tempfile.mkdtemp(prefix="tidemark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.checkpoint.dir", f"{base}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    result: DataFrame = QUERIES[name](spark, sf_dir)
    result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    best = {name: min(run(spark, name, sf_dir) for _ in range(REPEATS)) for name in HEADLINE}
    report = {
        "metric": "total_seconds",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in best.items()},
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
