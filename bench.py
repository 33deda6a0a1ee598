"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The ledger that most queries read is derived from the tables and stored once; ledger_fixture is the time of that. The other
times are medians of three runs (of one from the time on when RUNS_FOR seconds have gone)."""

import json
import os
import statistics
import tempfile
import time

RUNS_FOR = 300

HEADLINE = [
    "H1_revenue_status", "H2_totals", "H3_adjusted_revenue", "H4_statement_list", "H5_nested_statements", "H9_summary", "H11_monthly_flow", "H22_first_rows",
    "G1_confidence", "G2_reconciliation", "B2_content_fingerprint", "B3_duplicates", "B10_row_dedupe", "D1_amounts", "D2_dates",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from ledger_spark import fixtures, queries
    from ledger_spark.sources.scratch import stored

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", folder).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = queries.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start-up isn't a query's time
    began = time.time()
    ledger = stored(fixtures.ledger(spark, sf_dir))
    fixtures.ledger = lambda spark, sf_dir: ledger
    took = {"ledger_fixture": round(time.time() - began, 2)}
    for name in HEADLINE:
        runs = []
        while len(runs) < (3 if time.time() - began < RUNS_FOR else 1):
            at = time.time()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - at)
        took[name] = round(statistics.median(runs), 2)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
