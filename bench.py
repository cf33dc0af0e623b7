"""Time the headline queries. Prints one JSON line; reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import tempfile
import time

from millrace.operators.modelling import load_model, save_model
from millrace.plans.catalogue import QUERIES
from millrace.plans.catalogue.models import search_model, search_with
from millrace.session import build_session

HEADLINE = [
    "wide_tag_table", "build_mill_table", "combine_mill_and_lab", "resample_mean", "fill_both", "interpolate_linear", "process_series",
    "asof_join", "rolling_mean", "rolling_zscore", "ewm_recursive", "savgol", "estimate_lag_ccf", "corr_matrix", "windowed_corr",
    "regime_corr_spearman", "quantiles", "describe_numeric", "smart_binning", "binning_quality", "detect_pelt", "detect_binseg",
    "tune_penalty", "regime_study", "train_linear", "train_gbt", "search_setpoints", "assemble_shift_report", "stream_resample",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-")})
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the session and of Python workers is not part of a query
    spark.range(1000).groupBy("id").applyInPandas(lambda p: p, "id long").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    # a set-point search is run many times with one stored model, so its training is timed apart
    store = tempfile.mkdtemp(prefix="run-")
    begin = time.perf_counter()
    save_model(search_model(spark, folder), store, "search", "2025-01-01T00:00:00")
    times["train_search_model"] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    search_with(spark, folder, load_model(store, "search")).write.format("noop").mode("overwrite").save()
    times["search_with_model"] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
