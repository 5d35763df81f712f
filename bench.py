"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("common_input_links", "spend_resolution", "value_conservation", "address_history", "rapid_spends", "transaction_shapes", "peeling_hop", "coinjoin_like", "graph_edges", "endpoint_rollup", "risk_propagation", "peeling_walk")


def main() -> None:
    from pyspark.sql import SparkSession

    from utxolens.plans.all_queries import QUERIES
    from utxolens.plans.domain import Domain

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The session warms up and the derived tables are written before the clock starts; what that takes is printed.
    began = time.time()
    for table in ("tx", "tx_out", "tx_in", "obs"):
        getattr(Domain(spark, sf_dir), table)
    QUERIES["input_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    setup = round(time.time() - began, 3)
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "setup_sec": setup, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
