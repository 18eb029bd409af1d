"""Time the headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]`; prints one JSON line.

Each query runs once to warm up, then `$BENCH_RUNS` times (1 by default), of which the median counts. Results go to a sink that discards them, so
all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "validate_split", "validation_counts", "duplicates_report", "dedup_first", "descriptor_table", "aac", "mass_gravy_indices",
    "isoelectric_point", "instability", "hydrophobic_moment", "dipeptides_long", "criteria_score", "criteria_summary", "screened_ranking",
    "position_effects", "class_recommendations", "design_profile", "alignment_to_reference", "score_minimize",
    "predictions_with_criteria", "rank_predictions", "roc_auc", "split_stratified", "cv_folds", "corr_matrix", "impute_median",
    "knn_join", "fasta_roundtrip", "linear_regression_fit", "score_and_screen",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        # small files are split, so that all cores read them
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from query_suite import QUERIES
    from residua.operators.storage import drop_stored

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times = {}
    for name in wanted:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "1"))):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
            drop_stored(spark)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
