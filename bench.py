"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS say where and on how many cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablediff import queries
from tablediff.plans.diff import diff_table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Each is run once to warm up and then so many times, of which the median counts.
RUNS = 3


def self_comparison(spark: SparkSession, rows: int, measures: int, changed: int):
    """A table with unique keys against a copy in which one cell in `changed` differs by 1; rows x measures cells."""
    x = spark.range(rows).select(
        (F.col("id") + 1).cast("int").alias("id"), *[(F.col("id") + 1 + j / 1000).cast("double").alias(f"m{j}") for j in range(1, measures + 1)]
    )
    y = x.select("id", *[(F.col(f"m{j}") + F.when((F.col("id") + j) % changed == 0, 1.0).otherwise(0.0)).alias(f"m{j}") for j in range(1, measures + 1)])
    return diff_table(x, y, by="id")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    from_tables = [
        "diff_cells", "diff_abs_tolerance", "diff_cast_text", "diff_disambiguate", "diff_aggregate", "diff_rows_multiset", "diff_sorted",
        "summary_cells", "report_row_counts", "report_top_changes", "compared_columns", "dry_run_of_merge",
    ]
    tasks = {n: (lambda n=n: drain(queries.QUERIES[n](spark, SF_DIR))) for n in from_tables}
    tasks |= {
        "cells_1m_construct": lambda: drain(self_comparison(spark, 50_000, 20, 100).df),
        "cells_5m_construct": lambda: drain(self_comparison(spark, 100_000, 50, 100).df),
        "cells_5m_summary": lambda: drain(self_comparison(spark, 100_000, 50, 100).summary()),
    }
    times = {}
    for name, task in tasks.items():
        task()
        taken = []
        for _ in range(RUNS):
            began = time.perf_counter()
            task()
            taken.append(time.perf_counter() - began)
        times[name] = round(sorted(taken)[RUNS // 2], 3)
    print(json.dumps({"metric": "sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
