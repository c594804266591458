"""Times the headline queries: one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: threads."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from coilwave.plans.catalog import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in QUERIES.items():
        runs = []
        for _ in range(3):
            began = time.time()
            query(spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "median of three runs, summed over the queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER}))


if __name__ == "__main__":
    main()
