"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from pagegraph import catalog

HEADLINE = ["flagship_host_summary", "canonicalize_url", "resolve_url", "url_distinct", "dedup_anti", "first_discovery", "crawl_bfs", "redirect_chain", "metric_stats", "mad", "cliffs_delta", "coverage_score", "retry_decision", "oracle_diff", "tool_rollup"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda n=name: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()  # warm-up
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times)[1], 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
