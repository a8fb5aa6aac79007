"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each and in all."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ["momentum_rank_ic", "panel_resample", "factors_along_assets", "factors_across_dates", "factors_nested", "factors_twenty", "preprocess_pipeline", "ic_daily", "layer_stats", "factor_turnover", "factor_screen", "train_eval_fitness", "signal_analysis", "overfit_check", "subset_scores", "text_features", "text_unified_panel", "report_records", "library_similar", "library_quality_gate", "model_ridge"]


def main() -> None:
    from pyspark.sql import SparkSession

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from factorloom.plans import registry

    queries, took = registry.queries(), {}
    queries["momentum_rank_ic"](spark, SF_DIR).collect()  # starts the session's machinery
    for name in sys.argv[1:] or HEADLINES:
        began = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
