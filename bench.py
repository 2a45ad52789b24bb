"""Wall time of the headline operators at one scale; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3)
Each query is evaluated in full through the ``noop`` sink; the value is the median of the runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabml.operators import metrics as M  # noqa: E402
from tabml.operators import split as SP  # noqa: E402
from tabml.plans import registry as R  # noqa: E402
from tabml.session import build_session  # noqa: E402
from tabml.sources import views as V  # noqa: E402


def _split_window(spark, sf):
    df = SP.prepare_for_split(V.orders_labeled(spark, sf), R.FLAG_SPEC)
    return SP.train_test_split(df, R.FLAG_SPEC, key="o_orderkey", method="window")


def _split_lineitem(spark, sf):
    """Unkeyed split of the largest table (row hash order, 3-class stratified)."""
    spec = R._spec("classification", "l_returnflag")
    df = SP.prepare_for_split(V.table(spark, sf, "lineitem"), spec)
    return SP.train_test_split(df, spec)


def _profile_lineitem(spark, sf):
    from tabml.operators import profile as P
    _, prof = P.clean_and_profile(V.table(spark, sf, "lineitem"), R._spec("classification", "l_returnflag"))
    return P.profile_frame(spark, prof)


def _roc_auc_lineitem(spark, sf):
    """AUC with a continuous score (every row a distinct-ish score)."""
    df = V.predictions(spark, sf).withColumn("score", F.col("y") / 100000.0)
    return M.roc_auc(df, "label", "score")


BENCH = {
    "data_profile": _profile_lineitem,
    "data_profile_gaps": R.QUERIES["data_profile"],
    "fit_features": R.QUERIES["fit_features"],
    "train_test_split": R.QUERIES["train_test_split"],
    "train_test_split_window": _split_window,
    "train_test_split_lineitem": _split_lineitem,
    "cv_folds": R.QUERIES["cv_folds"],
    "macro_prf": R.QUERIES["macro_prf"],
    "roc_auc": R.QUERIES["roc_auc"],
    "roc_auc_continuous": _roc_auc_lineitem,
    "cv_score": R.QUERIES["cv_score"],
}


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in sys.argv[1:] if k in BENCH]
    spark = build_session(f"local[{cpus}]", app="tabml-bench", shuffle_partitions=int(cpus) * 2)
    R.QUERIES["class_balance"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up the JVM
    times = {}
    for name in only or BENCH:
        fn = BENCH[name]
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(samples), 3)
    sf_name = os.path.basename(sf.rstrip("/"))
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name.replace("sf", ""), "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
