"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (cores of the local master).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

HEADLINE = [
    "scan_summary", "custom_rule_tokens", "line_gate", "risk_score", "dedup_findings", "correlated_findings",
    "ioc_reputation", "verdict_apply", "vulnerable_deps", "dependencies_merged", "incremental_rescan", "claim_check",
    "sanitize_text", "repo_urls", "url_report", "file_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("glintscan.scan.partitions", 2 * int(cpus)).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from glintscan.plans import repository
    from workload.corpus import files
    from workload.queries import QUERIES

    size = files(spark, sf_dir).select(
        F.sum(F.size(F.split("content", "\n"))).alias("lines"), F.sum(F.octet_length("content")).alias("bytes")).first()
    QUERIES["scan_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # class loading and JIT
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scan = repository.scan(files(spark, sf_dir), partitions=2 * int(cpus))
    runs = []
    for _ in range(3):
        start = time.perf_counter()
        scan.write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - start)
    per_core = 1 / min(runs) / int(cpus)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else None, "lines": size["lines"], "bytes": size["bytes"],
        "scan_lines_per_sec_per_core": round(size["lines"] * per_core),
        "scan_mb_per_sec_per_core": round(size["bytes"] * per_core / 1e6, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
