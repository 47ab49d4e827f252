"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pricewell.plans import registry

HEADLINE = [
    "qry1_card_search", "qry2_card_trend", "qry3_printings_with_prices", "qry4_price_history", "qry5_card_snapshot", "qry6_due_cards",
    "qry7_match_listings", "qry12_price_table", "qry11_match_summary", "set2_price_pivot", "flt5_market_items", "snk2_append_history",
    "jon7_near_keys", "scl1_name_keys",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pricewell-bench")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, took = registry.queries(), {}
    only = sys.argv[1:] or HEADLINE
    for name in ["qry5_card_snapshot", *only]:  # the first run warms the JVM up and is timed again
        began = time.time()
        made[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
