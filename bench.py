"""Times headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from sparkloom import plans

HEADLINE = ["vector_topk", "bm25_topk", "hybrid_rrf", "bm25_stats", "tokenize", "chunk_fixed_simple", "hourly_counters", "pctl_nearest", "sliding_latency", "conversation_window", "risk_score", "request_totals", "contract_savings", "approval_routing", "budget_running", "least_connections", "purchase_orders"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["kv_lookup"](spark, sf).collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
