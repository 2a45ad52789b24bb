"""Bulk run documents, their JSON and the relational tables, against single-run reading and hand-made cases."""

import json

from tabml.reports import (CleaningAction, ColumnSchema, DataProfile, EDAReport, EvaluationReport, FailureAnalysis, FeatureDecision,
                           HistoryEntry, PipelineRun, TraceEntry, TrialRecord, TuningResult)
from tabml.sources import documents as DOC
from tabml.sources import runstore as RS
from tabml.spec import PipelineConstraints, ProblemSpec


def full_run():
    spec = ProblemSpec("classification", "y", "f1", 0.8, "a.csv", PipelineConstraints(60, 10, True, 2), "a note")
    return PipelineRun(
        "r.1", spec, "evaluated", 1,
        DataProfile(10, 2, [ColumnSchema("x", "double", 12.5), ColumnSchema("y", "string", 0.0, True)], {"a": 0.6, "b.c": 0.4}, ["x"],
                    [CleaningAction("x", "median_imputation", "1 gap")], [], None),
        EDAReport({"x": 0.25, "x__sq": -0.5}, [FeatureDecision("x__sq", "square")], [], ["leak"], [], "even", ["x", "x__sq"]),
        TuningResult({"max_depth": 4, "rate": 0.5}, 0.75, "f1_macro", [TrialRecord(0, {"max_depth": 2}, 0.5), TrialRecord(1, {"max_depth": 4}, 0.75)],
                     True, 2, 2, "settled"),
        EvaluationReport({"f1": 0.7, "accuracy": 0.75}, "f1", 0.7, 0.8, "fail", [[3, 1], [0, 6]], None, FailureAnalysis("short", "revisit_features"), "m/1"),
        [HistoryEntry("2024-01-01T00:00:00", "orchestrator", "run started"), HistoryEntry("2024-01-01T00:00:01.500000", "data_agent", "proceed=True")],
        [TraceEntry("data_agent", "m", 100, 20, 120, 1.5, 0.25, "2024-01-01T00:00:02")])


def store(spark, tmp_path, name="s"):
    root = str(tmp_path / name)
    RS.persist_run_state(spark, root, full_run())
    empty = ProblemSpec("regression", "t", "rmse", 2.0, "b.parquet")
    RS.persist_run_state(spark, root, PipelineRun("r.2", empty))
    RS.persist_run_state(spark, root, PipelineRun("r.3", empty, data_profile=DataProfile(0, 0), evaluation_report=EvaluationReport(
        {}, "rmse", 1.0, 2.0, "pass", None, {"mean": 0.5})))
    return root


def leaf_map(docs):
    return {(r.run_id, r.path): r.text if r.text is not None else r.number for r in DOC.leaves(docs).collect()}


def test_documents_equal_single_reading(spark, tmp_path):
    root = store(spark, tmp_path)
    rows = {r.run_id: r for r in DOC.run_documents(spark, root).collect()}
    assert set(rows) == {"r.1", "r.2", "r.3"}
    for run_id, r in rows.items():
        one = RS.load_run_state(spark, root, run_id).to_dict()
        got = r.asDict(recursive=True)
        assert (got.pop("total_cost_usd"), got.pop("total_tokens")) == ((0.25, 120) if run_id == "r.1" else (0.0, 0))
        got.pop("created_at"), got.pop("updated_at")
        if one["tuning_result"]:   # parameters are text in the table form
            one["tuning_result"]["best_params"] = {k: str(v) for k, v in one["tuning_result"]["best_params"].items()}
            for t in one["tuning_result"]["search_history"]:
                t["params"] = {k: str(v) for k, v in t["params"].items()}
        for h in [*got["history"], *got["trace"]]:
            h["timestamp"] = h["timestamp"].removesuffix(".000000")
        assert got == one
    assert rows["r.2"].data_profile is None and rows["r.2"].history == [] and rows["r.3"].data_profile.warnings == []


def test_json_round_trip_and_odd_texts(spark, tmp_path):
    docs = DOC.run_documents(spark, store(spark, tmp_path))
    texts = DOC.documents_json(docs)
    keep = [f.name for f in DOC.DOCUMENT.fields]
    back = DOC.documents_from_json(texts)
    assert leaf_map(back.drop("invalid")) == leaf_map(docs.select(*keep)) and back.where("invalid is not null").count() == 0
    raw = json.loads(texts.where("run_id = 'r.1'").first()["json"])
    assert raw["problem_spec"]["constraints"]["max_tuning_trials"] == 10 and raw["evaluation_report"]["confusion_matrix"] == [[3, 1], [0, 6]]
    odd = ['{"run_id": "a", "unknown": {"x": 1}, "status": "done"}', "no json", '{"status": "done"}', None, "", '{"run_id": "b", "history": null}']
    got = DOC.documents_from_json(spark.createDataFrame([(t,) for t in odd], "json string")).collect()
    assert [r.run_id for r in got] == ["a", None, None, None, None, "b"]
    assert [r.invalid for r in got] == [None, "no json", '{"status": "done"}', None, "", None]
    assert got[0].status == "done" and got[0].problem_spec is None and got[0].history == got[5].history == [] and got[1].status is None


def test_documents_written_in_bulk(spark, tmp_path):
    root = store(spark, tmp_path)
    docs = DOC.run_documents(spark, root)
    again = str(tmp_path / "again")
    DOC.write_documents(again, DOC.documents_from_json(DOC.documents_json(docs)))
    assert leaf_map(DOC.run_documents(spark, again)) == leaf_map(docs)
    assert RS.load_run_state(spark, again, "r.1").to_dict() == RS.load_run_state(spark, root, "r.1").to_dict()


def test_tables(spark, tmp_path):
    t = DOC.run_tables(spark, store(spark, tmp_path))
    assert len(t) == 26
    got = {k: sorted(tuple(r) for r in v.drop("run_id").collect()) for k, v in t.items() if k not in ("runs", "problem_specs", "pipeline_constraints")}
    assert got["column_schemas"] == [(0, "x", "double", 12.5, False), (1, "y", "string", 0.0, True)]
    assert got["class_balance_entries"] == [(0, "a", 0.6), (1, "b.c", 0.4)] and got["data_profile_warnings"] == []
    assert got["feature_decisions"] == [(0, "x__sq", "square", "engineered")] and got["leakage_warnings"] == [(0, "leak")]
    assert got["trial_record_params"] == [(0, "max_depth", "2"), (1, "max_depth", "4")]
    assert got["tuning_best_params"] == [(0, "max_depth", "4"), (1, "rate", "0.5")]
    assert got["confusion_matrix_cells"] == [(0, 0, 3), (0, 1, 1), (1, 0, 0), (1, 1, 6)]
    assert got["evaluation_reports"] == [("f1", 0.7, 0.8, "fail", "m/1"), ("rmse", 1.0, 2.0, "pass", None)]
    assert got["residual_summary_entries"] == [(0, "mean", 0.5)] and got["failure_analyses"] == [("short", "revisit_features")]
    assert sorted(r.run_id for r in t["data_profiles"].collect()) == ["r.1", "r.3"]   # an absent section has no row, an empty one has
    counts = {r.run_id: (r.n_kept, r.n_engineered, r.n_dropped, r.n_actions) for r in DOC.decision_counts(spark, store(spark, tmp_path, "c")).collect()}
    assert counts == {"r.1": (2, 1, 0, 1), "r.2": (None, None, None, None), "r.3": (None, None, None, 0)}


def test_empty_store(spark, tmp_path):
    root = str(tmp_path / "none")
    assert DOC.run_documents(spark, root).count() == 0
    assert all(v.count() == 0 for v in DOC.run_tables(spark, root).values())


def test_document_joins_are_on_run_id(spark, sf):
    from tabml.plans import registry as R
    plan = DOC.run_documents(spark, R._store(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "PythonUDF" not in plan


def test_compaction_beside_eight_writers(spark, tmp_path):
    """Every run's last write is in force afterwards, whatever the compactions in between took away."""
    from concurrent.futures import ThreadPoolExecutor
    root = str(tmp_path / "busy")
    spec = ProblemSpec("classification", "y", "f1", 0.8, "a.csv")

    def write(k):
        for n in range(4):
            RS.persist_run_state(spark, root, PipelineRun(f"w{k}", spec, f"s{n}", n, history=[HistoryEntry("2024-01-01T00:00:00", "o", f"e{i}") for i in range(n + 1)],
                                                          data_profile=DataProfile(k, 1) if n == 0 else None))

    def squeeze():
        for _ in range(4):
            RS.compact(spark, root)
    with ThreadPoolExecutor(9) as pool:
        jobs = [pool.submit(write, k) for k in range(8)] + [pool.submit(squeeze)]
        for j in jobs:
            j.result()
    RS.compact(spark, root)
    rows = {r.run_id: r for r in DOC.run_documents(spark, root).collect()}
    assert {k: (r.status, r.loop_count, len(r.history), r.data_profile.row_count) for k, r in rows.items()} == {f"w{k}": ("s3", 3, 4, k) for k in range(8)}
    assert RS._raw(spark, root, "history", RS.HISTORY_SCHEMA).count() == 32 and len(RS._versions(spark, root)) == 1   # nothing superseded is left


def test_compaction_keeps_rows_moved_but_not_committed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "late")
    spec = ProblemSpec("classification", "y", "f1", 0.8, "a.csv")
    RS.persist_run_state(spark, root, PipelineRun("a", spec, "old"))
    staged = []

    def half(spark, root, stage, names, version):
        for name in names:
            RS._move(spark, f"{stage}/{name}", f"{root}/{name}")
        staged.append(stage)
    monkeypatch.setattr(RS, "_publish", half)
    RS.persist_run_state(spark, root, PipelineRun("b", spec, "late"))   # rows are in the tables, the commit is not
    monkeypatch.undo()
    RS.compact(spark, root)
    RS.compact(spark, root)
    assert RS.load_run_state(spark, root, "b") is None and RS.load_run_state(spark, root, "a").status == "old"
    RS._move(spark, f"{staged[0]}/commits", f"{root}/commits")
    assert RS.load_run_state(spark, root, "b").status == "late" and RS.load_run_state(spark, root, "a").status == "old"


def test_a_write_opens_none_of_the_stored_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "big")
    h = spark.createDataFrame([("r", 0, None, "s", "e")], RS.HISTORY_SCHEMA)
    RS.write_history(root, h)
    monkeypatch.setattr(RS, "_raw", lambda *a: (_ for _ in ()).throw(AssertionError("stored rows were opened")))
    RS.write_history(root, h)
    assert len(RS._versions(spark, root)) == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_lists_are_rows_before_they_are_walked(spark):
    kind = "run_id string, status string, history array<struct<timestamp:string,stage:string,event:string>>, tuning_result struct<converged:boolean,search_history:array<struct<trial_number:int,params:map<string,string>>>>"
    docs = spark.createDataFrame([("a", "done", [("t", "s", None)], (True, [(0, {"x": "1"}), (1, {})])), ("b", None, [], None), ("c", "new", None, (None, None))], kind)
    got = DOC.leaves(docs)
    assert _plan(got).count("posexplode") == 2
    assert sorted((r.run_id, r.path, r.text, r.number) for r in got.collect()) == sorted([
        ("a", "status", "done", None), ("a", "history#", None, 1.0), ("a", "history[0].timestamp", "t", None), ("a", "history[0].stage", "s", None),
        ("a", "tuning_result.converged", None, 1.0), ("a", "tuning_result.search_history#", None, 2.0), ("a", "tuning_result.search_history[0].trial_number", None, 0.0),
        ("a", "tuning_result.search_history[0].params#", None, 1.0), ("a", "tuning_result.search_history[0].params.x", "1", None),
        ("a", "tuning_result.search_history[1].trial_number", None, 1.0), ("a", "tuning_result.search_history[1].params#", None, 0.0),
        ("b", "history#", None, 0.0), ("c", "status", "new", None)])


def test_parts_of_a_run_are_grouped_not_joined(spark):
    from tabml.plans.registry import _by_run

    base = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "run_id string, x int")
    p = spark.createDataFrame([("a", [1, 2]), ("z", [3]), (None, [4])], "run_id string, p array<int>")
    q = spark.createDataFrame([("b", {"k": 1.0})], "run_id string, q map<string,double>")
    got = _by_run(base, p, q)
    assert "Join" not in _plan(got)
    want = base.join(p, "run_id", "left").join(q, "run_id", "left")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sections_read_the_types_once(spark, sf):
    from tabml.sources import runviews as RV

    types = RV.types(spark, sf).checkpoint()
    assert "parquet" not in _plan(RV.section(types, "column_schema")).lower() and RV.section(types, "column_schema").count() > 0
