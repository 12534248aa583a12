"""Headline timings: runs each query once into a no-op sink and prints one JSON line."""

import json
import os
import time

from tidemark.plans.catalog import CATALOG
from tidemark.session import local_session

HEADLINE = [
    "d01_monthly_category_counts", "c03_asof_window_join", "c06_interval_overlap", "d04_distinct_entity_summary",
    "d14_horizon_label", "d27_sequence_assembly", "i06_panel_to_sequence", "i12_masked_descriptors",
    "j04_weighted_quantile", "j12_binned_mutual_information", "j17_correlated_pairs", "k01_decile_table",
    "k03_global_metrics", "k15_paired_lift_intervals", "k16_paired_curve_intervals", "l01_stratified_entity_split",
    "m02_tokeniser", "m05_sublinear_tfidf",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    # Small local data: keep shuffles spread over the cores instead of coalescing them into one task.
    spark = local_session(cores, "bench", **{
        "spark__sql__shuffle__partitions": cores, "spark__sql__adaptive__coalescePartitions__minPartitionSize": "256k"})
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
