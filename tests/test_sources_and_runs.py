import os
import tempfile

from pyspark.sql import functions as F

from tabml.operators import runs as RU
from tabml.reports import EvaluationReport, HistoryEntry, PipelineRun, TraceEntry
from tabml.sources import documents as DOC
from tabml.sources import files as SRC
from tabml.sources import runstore as RS
from tabml.spec import ProblemSpec


def test_csv_types_and_missing_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d\n1,x,2023-01-01,True\n2,y,NA,False\n,x,2023-01-03,True\n")
    df = SRC.scan_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "string", "c": "string", "d": "boolean"}
    assert df.where("a is null").count() == 1 and df.where("c is null").count() == 1


def test_missing_file_is_value_error(spark):
    import pytest
    with pytest.raises(ValueError):
        SRC.scan_parquet(spark, "/nonexistent/x.parquet")


def test_catalog_prefers_csv_twin(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("a\n1\n")
    spark.createDataFrame([(1,)], "a int").toPandas().to_parquet(tmp_path / "customers.parquet")
    cat = SRC.dataset_catalog(spark, str(tmp_path)).where("ord = 1").collect()
    assert len(cat) == 1 and cat[0]["source"].endswith("customers.csv") and cat[0]["label"] == "Customers"


def test_event_types(spark):
    df = spark.createDataFrame([("fail -> recommended_next_step=x",), ("escalated: no",), ("proceed=False",),
                                ("run passed — pipeline complete",), ("run started",)], "event string")
    got = [r[0] for r in df.select(RU.event_type(F.col("event"))).collect()]
    assert got == ["loop_back", "error", "warning", "success", "info"]


def test_run_store_round_trip_and_replace(spark, tmp_path):
    root = str(tmp_path / "store")
    spec = ProblemSpec("classification", "y", "f1", 0.8, "builtin:orders_status")
    run = PipelineRun("r1", spec, status="evaluated",
                      history=[HistoryEntry("2024-01-01T00:00:00", "orchestrator", "run started")],
                      trace=[TraceEntry("data_agent", "gpt-4o-mini", 100, 20, 120, 1.0, 0.000027)],
                      evaluation_report=EvaluationReport({"f1": 0.9}, "f1", 0.9, 0.8, "pass",
                                                         confusion_matrix=[[39, 3], [3, 69]]))
    RS.persist_run_state(spark, root, run)
    back = RS.load_run_state(spark, root, "r1")
    assert back.evaluation_report.confusion_matrix == [[39, 3], [3, 69]]
    assert back.history[0].event == "run started" and back.trace[0].total_tokens == 120
    # second write without the report keeps it; history is replaced, not duplicated
    run2 = PipelineRun("r1", spec, status="done", history=run.history * 2)
    RS.persist_run_state(spark, root, run2)
    back = RS.load_run_state(spark, root, "r1")
    assert back.status == "done" and back.evaluation_report.metric_value == 0.9 and len(back.history) == 2
    assert RS.load_run_state(spark, root, "nope") is None
    cells = DOC.run_tables(spark, root)["confusion_matrix_cells"].count()
    assert cells == 4


def test_resume_point(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("a", 1, t, "o", "fail -> recommended_next_step=revisit_features"),
                               ("b", 1, t, "o", "fail -> recommended_next_step=expand_hyperparam_search"),
                               ("c", 1, t, "o", "skipping feature_agent — resuming"),
                               ("d", 1, t, "o", "run started")], "run_id string, seq int, ts timestamp, stage string, event string")
    got = {r["run_id"]: r["resume_from"] for r in RU.resume_point(h).collect()}
    assert got == {"a": "feature", "b": "tuning", "c": "tuning", "d": None}


def test_tools_reuse_cache(spark, sf):
    from tabml.plans.tools import RunCache, engineer_features_tool, profile_dataset_tool
    cache = RunCache()
    prof = profile_dataset_tool(spark, "builtin:orders_status", "is_p", "classification", cache, "r", base_dir=sf)
    assert prof.row_count > 0 and cache.get("r", "deduped", "profile") is not None
    rep = engineer_features_tool(spark, "builtin:orders_status", "is_p", "classification", cache, "r", base_dir=sf)
    assert "o_orderstatus_P" in rep.final_feature_names
    assert cache.get("r", "X", "features")[1] == rep.final_feature_names
    assert cache.get("other", "X") is None


def test_tuning_trials_round_trip(spark, tmp_path):
    from tabml.reports import TrialRecord, TuningResult
    root = str(tmp_path / "store2")
    spec = ProblemSpec("regression", "y", "rmse", 10.0, "x.parquet")
    tr = TuningResult({"n_estimators": 120, "max_depth": 4}, -3.5, "neg_root_mean_squared_error",
                      [TrialRecord(0, {"n_estimators": 50, "max_depth": 2}, -4.0),
                       TrialRecord(1, {"n_estimators": 120, "max_depth": 4}, -3.5)], True, 2, 2, "ok")
    RS.persist_run_state(spark, root, PipelineRun("t1", spec, tuning_result=tr,
                                                  history=[HistoryEntry("2024-01-01T00:00:00", "o", "run started")]))
    back = RS.load_run_state(spark, root, "t1").tuning_result
    assert back.best_params == {"n_estimators": 120, "max_depth": 4}
    assert [(t.trial_number, t.params["n_estimators"], t.score) for t in back.search_history] == [(0, 50, -4.0), (1, 120, -3.5)]


def test_top_k_per_group_hot_group_both_paths(spark):
    import random
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 9)}", i, rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, id int, score int").repartition(6)
    want = set()
    for g in {r[0] for r in rows}:
        top = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:5]
        want |= {(g, r[1], k + 1) for k, r in enumerate(top)}
    order = [F.col("score").desc(), F.col("id")]
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    try:
        for threshold in ("1000", "2"):   # one window with a partial limit / salted first round
            spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
            got = {(r["grp"], r["id"], r["rank_in_group"]) for r in RU.top_k_per_group(df, "grp", order, 5).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)


def test_bucketed_store_replace_and_empty(spark):
    import datetime as dt
    from tabml.session import scratch_path
    root = scratch_path(spark, "bucketed")
    t = dt.datetime(2024, 1, 1)
    rows = [(r, i, t, "s", f"{r}-{i}") for r in ("a", "b", "c") for i in range(3)]
    RS.write_history(root, spark.createDataFrame(rows, RS.HISTORY_SCHEMA))
    RS.write_history(root, spark.createDataFrame([("a", 0, t, "s", "a-new")], RS.HISTORY_SCHEMA))
    got = sorted((r["run_id"], r["event"]) for r in RS._read(spark, root, "history", RS.HISTORY_SCHEMA).collect())
    assert got == [("a", "a-new")] + [(r, f"{r}-{i}") for r in ("b", "c") for i in range(3)]
    RS._replace(spark, root, "history", spark.createDataFrame([], RS.HISTORY_SCHEMA), RS.HISTORY_SCHEMA, "seq",
                run_ids=["b"])   # an empty list replaces the run's rows: they are gone
    got = sorted({r["run_id"] for r in RS._read(spark, root, "history", RS.HISTORY_SCHEMA).collect()})
    assert got == ["a", "c"]
    buckets = {r[0] for r in RS._stored(spark, root, "history", RS.HISTORY_SCHEMA).select("run_bucket").distinct().collect()}
    b_bucket = spark.range(1).select(RS._bucket_of(F.lit("b"))).first()[0]
    a_c = {spark.range(1).select(RS._bucket_of(F.lit(x))).first()[0] for x in ("a", "c")}
    assert buckets == a_c and (b_bucket in a_c or b_bucket not in buckets)


def test_store_keeps_trials_of_runs_without_a_row(spark, sf, monkeypatch):
    from tabml.plans import registry as R
    from tabml.sources import runviews as RV

    every = [tuple(r) for r in RV.trials(spark, sf).select("run_id", "trial_number", "score").collect()]
    gone = every[0][0]
    full = R._runs_ext
    monkeypatch.setattr(R, "_runs_ext", lambda spark, sf: full(spark, sf).where(F.col("run_id") != gone))
    assert sorted(tuple(r) for r in R.q_run_store_trials(spark, sf).collect()) == sorted(every)
