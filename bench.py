"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    threads of the local session (default 8)
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from quarrylens.operators import profile as P
from quarrylens.plans import models as L
from quarrylens.plans.battery import test_battery
from quarrylens.plans.registry import QUERIES, load_all
from quarrylens.session import get_session
from quarrylens.sources.files import read_csv

HEADLINE = (
    "rfm_segments_b", "rfm_a", "cohort_retention", "basket_pairs", "funnel", "column_stats", "detect_outliers_iqr",
    "remove_duplicates_first", "rolling_features", "target_encode", "robust_scale", "bin_quantile", "chi_square",
    "mann_whitney_u", "kruskal_wallis", "spearman", "kaplan_meier_groups", "concordance_index", "gini", "psi_b",
    "drift_numeric", "charlson", "classification_metrics", "knn_predict", "vector_search", "pdp", "text_length",
)
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "quarrylens-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    run(lineitem.limit(1000).groupBy("l_returnflag").count())  # start the JVM workers
    for name in HEADLINE:
        timed(name, lambda: run(QUERIES[name](spark, folder)))

    csv = tempfile.mkdtemp(prefix="quarrylens-bench-") + "/orders"
    spark.read.parquet(f"{folder}/orders.parquet").write.option("header", True).csv(csv)
    timed("csv_load", lambda: run(read_csv(spark, csv)))
    timed("profile_lineitem", lambda: run(P.profile(lineitem)))
    timed("test_battery_lineitem", lambda: run(test_battery(lineitem.drop("l_shipdate"), "l_returnflag")))

    rows = lineitem.select(*FEATURES, "l_extendedprice").repartition(int(cpus)).persist()
    timed("train_five_models", lambda: [
        L.train(rows, FEATURES, "l_extendedprice", a, problem="regression")
        for a in ("linear_regression", "ridge", "lasso", "decision_tree", "random_forest")])
    model = L.train(rows, FEATURES, "l_extendedprice", "linear_regression", problem="regression")
    timed("score_lineitem", lambda: run(L.score(lineitem, model, FEATURES, ["l_orderkey"])))
    timed("auto_pipeline", lambda: run(QUERIES["auto_pipeline"](spark, folder)))
    rows.unpersist()

    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
