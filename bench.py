"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed once over the whole tables, building the plan included. Before that it runs untimed on the smallest
data set next to the measured one, so that compiling the generated code and starting Python workers is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "diff_lines", "added_chunks", "function_spans", "rule_secrets", "analyze", "analyze_documents", "review_summary",
    "apply_fixes", "facts_functions", "verification_rollup", "pytest_suites", "parse_model_json",
]


def main() -> None:
    from pullscan.plans.registry import QUERIES
    from pullscan.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that starting the session is not part of a result.
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINE:
        if os.path.isdir(small):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    lines = QUERIES["source_lines"](spark, sf_dir).count()
    rate = {k: round(lines / seconds[k]) for k in ("diff_lines", "analyze", "apply_fixes", "function_spans")}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "source_lines": lines, "lines_per_sec": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
