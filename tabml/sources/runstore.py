"""The run store as Parquet tables keyed by ``run_id``.

Tables are partitioned by ``run_bucket`` = hash(run_id) mod STORE_BUCKETS (not by run_id: one
folder per run would not survive millions of runs) and are append-only. A write stages its own rows in a
folder of its own, moves the finished files into the tables and then adds one line per (run, table) to
``commits``; all its rows carry one version. A reader takes, per run and table, the rows of the largest
committed version, so concurrent writers of different runs never touch each other's rows, a crash before
the commit leaves the earlier state in force, and a write costs its own rows, never the store's: the versions in use are
names of empty files in ``_versions``, which a writer only lists. Of concurrent writers of one run the last commit wins.
``compact`` drops superseded rows while writers go on. Files are clustered by
(run_bucket, run_id, order), so reading one run prunes to its bucket and to a few row groups.

- ``runs``     one row per run: status, loop count, times, the spec and the four stage reports as
               structs. Their lists are bounded by the run's own configuration (columns, candidates,
               trial budget, classes x classes), never by event volume.
- ``history``  one row per logged event (seq, ts, stage, event).
- ``trace``    one row per model call.
- ``trials``   one row per search trial (its list grows with the search, so it is not an array).

Section semantics of ``persist_run_state``: the spec is always replaced, a report is replaced when
present and kept when absent, history and trace are replaced as whole lists. The 26 relational
tables of the reference are views over these (``tabml.sources.documents``).
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabml.reports import (CleaningAction, ColumnSchema, DataProfile, EDAReport, EvaluationReport,
                           FailureAnalysis, FeatureDecision, HistoryEntry, PipelineRun, TraceEntry, TrialRecord,
                           TuningResult)
from tabml.operators.stats import broadcast_if_small
from tabml.spec import PipelineConstraints, ProblemSpec

SPEC_T = ("struct<task_type:string,target_column:string,success_metric:string,metric_threshold:double,"
          "data_source:string,max_training_seconds:int,max_tuning_trials:int,interpretability_required:boolean,"
          "max_loop_backs:int,notes:string>")
PROFILE_T = ("struct<row_count:bigint,column_count:int,column_schema:array<struct<name:string,dtype:string,"
             "missing_pct:double,is_target:boolean>>,class_balance:array<struct<label:string,share:double>>,"
             "outlier_flags:array<string>,cleaning_actions_taken:array<struct<column:string,action:string,"
             "rationale:string>>,warnings:array<string>,blocking_issue:string>")
EDA_T = ("struct<correlation_summary:array<struct<feature:string,corr:double>>,"
         "engineered_features:array<struct<name:string,rationale:string>>,"
         "dropped_features:array<struct<name:string,rationale:string>>,leakage_warnings:array<string>,"
         "data_quality_warnings:array<string>,target_distribution_notes:string,final_feature_names:array<string>>")
TUNING_T = ("struct<best_params:map<string,string>,best_cv_score:double,metric_optimized:string,"
            "converged:boolean,search_budget_used:int,search_budget_total:int,convergence_notes:string>")
EVAL_T = ("struct<test_metrics:map<string,double>,metric_optimized:string,metric_value:double,"
          "metric_threshold:double,pass_fail:string,confusion_matrix:array<array<bigint>>,"
          "residual_summary:map<string,double>,failure_analysis:struct<summary:string,recommended_next_step:string>,"
          "model_artifact_path:string>")
RUNS_SCHEMA = (f"run_id string, status string, loop_count int, created_at timestamp, updated_at timestamp, "
               f"spec {SPEC_T}, data_profile {PROFILE_T}, eda_report {EDA_T}, tuning_result {TUNING_T}, "
               f"evaluation_report {EVAL_T}")
HISTORY_SCHEMA = "run_id string, seq bigint, ts timestamp, stage string, event string"
TRIALS_SCHEMA = "run_id string, trial_number int, params map<string,string>, score double"
TRACE_SCHEMA = ("run_id string, seq bigint, ts timestamp, agent string, model string, prompt_tokens bigint, "
                "completion_tokens bigint, total_tokens bigint, latency_ms double, estimated_cost_usd double")
COMMITS_SCHEMA = "run_id string, part string, version string"
SECTIONS = ("data_profile", "eda_report", "tuning_result", "evaluation_report")


def _path(root: str, name: str) -> str:
    return os.path.join(root, name)


STORE_BUCKETS = 64


def _bucket_of(run_id):
    return F.pmod(F.xxhash64(run_id), F.lit(STORE_BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(bucket folder, file) of every data file of a table."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [(d.getPath().getName(), f.getPath().getName()) for d in fs.listStatus(p) if d.isDirectory()
            for f in fs.listStatus(d.getPath())]


def _move(spark: SparkSession, staged: str, path: str) -> None:
    """Move finished files (their names are unique) into the bucket folders of a table."""
    fs, _ = _fs(spark, path)
    for folder, name in _files(spark, staged):
        to = _fs(spark, os.path.join(path, folder))[1]
        fs.mkdirs(to)
        if not fs.rename(_fs(spark, os.path.join(staged, folder, name))[1], _fs(spark, os.path.join(path, folder, name))[1]):
            raise OSError(f"cannot move {name} to {to}")


def _raw(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """Every stored row, superseded and uncommitted ones too."""
    path = _path(root, name)
    if not _exists(spark, path):
        return None
    extra = "" if name == "commits" else "version string, "
    return spark.read.schema(f"{schema}, {extra}run_bucket int").option("basePath", path).parquet(path)


def _heads(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, part, version): the version in force of every run and table."""
    commits = _raw(spark, root, "commits", COMMITS_SCHEMA)
    if commits is None:
        return spark.createDataFrame([], COMMITS_SCHEMA)
    return commits.groupBy("run_id", "part").agg(F.max("version").alias("version"))


def _run_heads(spark: SparkSession, root: str, run_id: str) -> dict[str, str]:
    commits = _raw(spark, root, "commits", COMMITS_SCHEMA)
    if commits is None:
        return {}
    mine = commits.where((F.col("run_bucket") == _bucket_of(F.lit(run_id))) & (F.col("run_id") == run_id))
    return {r["part"]: r["version"] for r in mine.groupBy("part").agg(F.max("version").alias("version")).collect()}


def _stored(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """The rows in force, with their bucket."""
    raw = _raw(spark, root, name, schema)
    if raw is None:
        return None
    heads = _heads(spark, root).where(F.col("part") == name).select("run_id", "version")
    return raw.join(broadcast_if_small(heads), ["run_id", "version"], "left_semi").drop("version")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    st = _stored(spark, root, name, schema)
    cols = spark.createDataFrame([], schema)
    return cols if st is None else st.select(*cols.columns)


def _run_rows(spark: SparkSession, root: str, name: str, schema: str, run_id: str,
              heads: dict[str, str] | None = None) -> DataFrame:
    """The rows of one run: its bucket folder only (partition pruning), then the run_id filter."""
    version = (_run_heads(spark, root, run_id) if heads is None else heads).get(name)
    raw = _raw(spark, root, name, schema)
    if version is None or raw is None:
        return spark.createDataFrame([], schema)
    return raw.where((F.col("run_bucket") == _bucket_of(F.lit(run_id))) & (F.col("run_id") == run_id)
                     & (F.col("version") == version)).drop("run_bucket", "version")


def _clustered(df: DataFrame, order: str | None) -> DataFrame:
    """Range-partition and sort by (run_bucket, run_id, order) before the bucket-partitioned write:
    a task holds a contiguous key range (about one file per bucket and task boundary), a run
    holding a third of the rows is cut into many tasks by its order column, and sorted row groups
    let a one-run read skip the rest of its bucket."""
    keys = ["run_bucket", "run_id"] + ([order] if order else [])
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _next_version(after: str | None) -> str:
    """Larger than ``after`` and unique: the clock, or one past a stored version that is ahead of it."""
    ticks = max(time.time_ns(), int(after[:20]) + 1 if after else 0)
    return f"{ticks:020d}-{uuid.uuid4().hex}"


def _replace_all(spark: SparkSession, root: str, parts: list[tuple], after: str | None) -> None:
    """Write new versions of some tables' runs and commit them together. ``parts``: (name, rows, schema, order, run_ids); the runs
    replaced are those of the rows, or run_ids (a run whose list is now empty)."""
    version = _next_version(after)
    stage = os.path.join(root, "_staged", version)
    heads = None
    for name, new, schema, order, run_ids in parts:
        cols = spark.createDataFrame([], schema).columns
        out = new.select(*cols, F.lit(version).alias("version"), _bucket_of(F.col("run_id")).alias("run_bucket"))
        staged = os.path.join(stage, name)
        _clustered(out, order).write.partitionBy("run_bucket").parquet(staged)
        ids = (spark.read.schema(f"{schema}, version string, run_bucket int").parquet(staged).select("run_id").distinct()
               if run_ids is None else spark.createDataFrame([(r,) for r in run_ids], "run_id string"))
        ids = ids.select("run_id", F.lit(name).alias("part"))
        heads = ids if heads is None else heads.unionByName(ids)
    _stage_commits(heads.withColumn("version", F.lit(version)), stage)
    _publish(spark, root, stage, [p[0] for p in parts], version)


def _stage_commits(heads: DataFrame, stage: str) -> None:
    (heads.withColumn("run_bucket", _bucket_of(F.col("run_id"))).repartition("run_bucket")
     .write.partitionBy("run_bucket").parquet(os.path.join(stage, "commits")))


def _publish(spark: SparkSession, root: str, stage: str, names: list[str], version: str) -> None:
    """Name the version, move the staged tables into the store, the commits last, and remove the stage."""
    fs, p = _fs(spark, os.path.join(root, "_versions", version))
    fs.create(p).close()
    for name in [*names, "commits"]:
        _move(spark, os.path.join(stage, name), _path(root, name))
    fs, p = _fs(spark, stage)
    fs.delete(p, True)


def _replace(spark: SparkSession, root: str, name: str, new: DataFrame, schema: str, order: str | None,
             run_ids: list[str] | None = None) -> None:
    """Replace every row of the runs in ``new`` (or ``run_ids``: a run whose list is now empty) by the rows of ``new``."""
    _replace_all(spark, root, [(name, new, schema, order, run_ids)], _latest(spark, root))


def _versions(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, os.path.join(root, "_versions"))
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _latest(spark: SparkSession, root: str) -> str | None:
    """The largest version in use, from file names only."""
    return max(_versions(spark, root), default=None)


def compact(spark: SparkSession, root: str) -> None:
    """Drop superseded rows beside running writers.

    The commits found at the start name the versions that are compacted; the rows in force among them are written once more under
    versions just above their own, so a commit that comes later stays above. Only files that hold rows of those versions go: the files
    of a writer that has moved its rows but not yet committed are of another version and stay. Readers that are under way may
    have to start again, as ``persist_run_state`` does."""
    tables = {"runs": (RUNS_SCHEMA, None), "history": (HISTORY_SCHEMA, "seq"), "trace": (TRACE_SCHEMA, "seq"),
              "trials": (TRIALS_SCHEMA, "trial_number")}
    known = _versions(spark, root)
    old_commits = _files(spark, _path(root, "commits"))
    if not old_commits:
        return
    paths = [os.path.join(_path(root, "commits"), *f) for f in old_commits]
    commits = (spark.read.schema(f"{COMMITS_SCHEMA}, run_bucket int").option("basePath", _path(root, "commits")).parquet(*paths)
               .select("run_id", "part", "version").checkpoint())
    heads = commits.groupBy("run_id", "part").agg(F.max("version").alias("version"))
    mark = f"~{time.time_ns():020d}{uuid.uuid4().hex[:12]}"   # one mark only: a row compacted again gets the newer one
    plain = F.substring_index("version", "~", 1)
    stage = os.path.join(root, "_staged", mark[1:])
    gone: list[tuple[str, str]] = [("commits", p) for p in paths]
    for name, (schema, order) in tables.items():
        raw = _raw(spark, root, name, schema)
        if raw is None:
            continue
        mine = heads.where(F.col("part") == name).select("run_id", "version")
        live = raw.join(broadcast_if_small(mine), ["run_id", "version"], "left_semi").select(*raw.columns)
        (_clustered(live.withColumn("version", F.concat(plain, F.lit(mark))), order)
         .write.partitionBy("run_bucket").parquet(os.path.join(stage, name)))
        settled = commits.where(F.col("part") == name).select("version").distinct()
        held = raw.select(F.input_file_name().alias("file"), "version").distinct()   # one row a file: a file is of one version
        gone += [(name, r["file"]) for r in held.join(settled, "version", "left_semi").select("file").distinct().collect()]
    _stage_commits(heads.withColumn("version", F.concat(plain, F.lit(mark))), stage)
    _publish(spark, root, stage, list(tables), max(known, default="0" * 20).split("~")[0] + mark)
    for _, path in gone:
        fs, p = _fs(spark, path)
        fs.delete(p, False)
    for version in known:
        fs, p = _fs(spark, os.path.join(root, "_versions", version))
        fs.delete(p, False)


# ---------------------------------------------------------------- document <-> row

def _spec_row(s: ProblemSpec) -> dict:
    c = s.constraints
    return dict(task_type=s.task_type, target_column=s.target_column, success_metric=s.success_metric,
                metric_threshold=float(s.metric_threshold), data_source=s.data_source,
                max_training_seconds=c.max_training_seconds, max_tuning_trials=c.max_tuning_trials,
                interpretability_required=c.interpretability_required, max_loop_backs=c.max_loop_backs, notes=s.notes)


def _param_text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _section_row(name: str, doc):
    if doc is None:
        return None
    if name == "data_profile":
        return dict(row_count=doc.row_count, column_count=doc.column_count,
                    column_schema=[c.to_dict() for c in doc.column_schema],
                    class_balance=None if doc.class_balance is None else
                    [dict(label=k, share=float(v)) for k, v in doc.class_balance.items()],
                    outlier_flags=list(doc.outlier_flags),
                    cleaning_actions_taken=[a.to_dict() for a in doc.cleaning_actions_taken],
                    warnings=list(doc.warnings), blocking_issue=doc.blocking_issue)
    if name == "eda_report":
        return dict(correlation_summary=[dict(feature=k, corr=float(v)) for k, v in doc.correlation_summary.items()],
                    engineered_features=[d.to_dict() for d in doc.engineered_features],
                    dropped_features=[d.to_dict() for d in doc.dropped_features],
                    leakage_warnings=list(doc.leakage_warnings), data_quality_warnings=list(doc.data_quality_warnings),
                    target_distribution_notes=doc.target_distribution_notes,
                    final_feature_names=list(doc.final_feature_names))
    if name == "tuning_result":
        return dict(best_params={k: _param_text(v) for k, v in doc.best_params.items()},
                    best_cv_score=float(doc.best_cv_score), metric_optimized=doc.metric_optimized,
                    converged=doc.converged, search_budget_used=doc.search_budget_used,
                    search_budget_total=doc.search_budget_total, convergence_notes=doc.convergence_notes)
    if name == "evaluation_report":
        return dict(test_metrics={k: float(v) for k, v in doc.test_metrics.items()},
                    metric_optimized=doc.metric_optimized, metric_value=float(doc.metric_value),
                    metric_threshold=float(doc.metric_threshold), pass_fail=doc.pass_fail,
                    confusion_matrix=doc.confusion_matrix,
                    residual_summary=doc.residual_summary,
                    failure_analysis=None if doc.failure_analysis is None else doc.failure_analysis.to_dict(),
                    model_artifact_path=doc.model_artifact_path)
    raise KeyError(name)


def parse_param_value(text: str):
    """F5 on the driver: float where the text holds "." or "e", int otherwise, the text itself where that fails."""
    kind = float if "." in text or "e" in text.lower() else int
    try:
        return kind(text)
    except ValueError:
        return text


READ_TRIES = 6


def _stored_run(spark: SparkSession, root: str, run_id: str) -> tuple[dict[str, str], Row | None]:
    """(versions in force, row) of one run; read again when a compaction took the files away in between."""
    for left in reversed(range(READ_TRIES)):
        try:
            heads = _run_heads(spark, root, run_id)
            return heads, load_run_row(spark, root, run_id, heads)
        except Exception as e:  # noqa: BLE001 - Spark wraps the missing file in several ways
            if left == 0 or not any(t in str(e) for t in ("FileNotFound", "FILE_NOT_EXIST", "does not exist", "PATH_NOT_FOUND")):
                raise
            time.sleep(0.2)
    raise AssertionError


def persist_run_state(spark: SparkSession, root: str, run: PipelineRun) -> None:
    """Idempotent replace of one run (spec always, reports when present, history/trace whole)."""
    heads, old = _stored_run(spark, root, run.run_id)
    sections = {}
    for s in SECTIONS:
        new = _section_row(s, getattr(run, s))
        sections[s] = new if new is not None else (old[s] if old is not None else None)
    times = [h.timestamp for h in run.history]
    created = min(times) if times else (old["created_at"] if old is not None else None)
    updated = max(times) if times else (old["updated_at"] if old is not None else None)
    row = dict(run_id=run.run_id, status=run.status, loop_count=run.loop_count, created_at=_ts(created),
               updated_at=_ts(updated), spec=_spec_row(run.problem_spec), **sections)
    hist = [(run.run_id, i, _ts(h.timestamp), h.stage, h.event) for i, h in enumerate(run.history)]
    trace = [(run.run_id, i, _ts(t.timestamp), t.agent, t.model, t.prompt_tokens, t.completion_tokens, t.total_tokens,
              float(t.latency_ms), float(t.estimated_cost_usd)) for i, t in enumerate(run.trace)]
    lists = [("history", hist, HISTORY_SCHEMA, "seq"), ("trace", trace, TRACE_SCHEMA, "seq")]
    if run.tuning_result is not None:   # present section: its trial list is replaced as a whole
        trials = [(run.run_id, t.trial_number, {k: _param_text(v) for k, v in t.params.items()}, float(t.score))
                  for t in run.tuning_result.search_history]
        lists.append(("trials", trials, TRIALS_SCHEMA, "trial_number"))
    parts = [("runs", spark.createDataFrame([Row(**row)], RUNS_SCHEMA), RUNS_SCHEMA, None, [run.run_id])]
    parts += [(name, spark.createDataFrame(rows, schema), schema, order, [run.run_id]) for name, rows, schema, order in lists]
    _replace_all(spark, root, parts, max(heads.values(), default=None))


def _ts(v):
    if v is None or not isinstance(v, str):
        return v
    import datetime as dt
    return dt.datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)


def write_runs_frame(root: str, runs: DataFrame, history: DataFrame | None = None,
                     trace: DataFrame | None = None, trials: DataFrame | None = None) -> None:
    """S6 in bulk: DataFrames in the store schemas; each run present in a frame is replaced there."""
    spark = runs.sparkSession
    parts = [("runs", runs, RUNS_SCHEMA, None, None), ("trials", trials, TRIALS_SCHEMA, "trial_number", None),
             ("history", history, HISTORY_SCHEMA, "seq", None), ("trace", trace, TRACE_SCHEMA, "seq", None)]
    _replace_all(spark, root, [p for p in parts if p[1] is not None], _latest(spark, root))


def write_history(root: str, history: DataFrame) -> None:
    """Replace the whole history of every run present in ``history``."""
    _replace(history.sparkSession, root, "history", history, HISTORY_SCHEMA, "seq")


def load_run_row(spark: SparkSession, root: str, run_id: str, heads: dict[str, str] | None = None):
    """One run's row: its bucket folder only, and row groups skipped by run_id statistics."""
    rows = _run_rows(spark, root, "runs", RUNS_SCHEMA, run_id, heads).collect()
    return rows[0] if rows else None


def load_run_state(spark: SparkSession, root: str, run_id: str) -> PipelineRun | None:
    """Rebuild the nested document of one run, or None for an unknown run."""
    heads = _run_heads(spark, root, run_id)   # one version set for all parts of the document
    r = load_run_row(spark, root, run_id, heads)
    if r is None:
        return None
    s = r["spec"]
    spec = ProblemSpec(s["task_type"], s["target_column"], s["success_metric"], s["metric_threshold"],
                       s["data_source"], PipelineConstraints(s["max_training_seconds"], s["max_tuning_trials"],
                                                             bool(s["interpretability_required"]), s["max_loop_backs"]),
                       s["notes"])
    run = PipelineRun(run_id=run_id, problem_spec=spec, status=r["status"], loop_count=r["loop_count"])
    p = r["data_profile"]
    if p is not None:
        run.data_profile = DataProfile(
            p["row_count"], p["column_count"], [ColumnSchema(**c.asDict()) for c in p["column_schema"]],
            None if p["class_balance"] is None else {e["label"]: e["share"] for e in p["class_balance"]},
            list(p["outlier_flags"]), [CleaningAction(**a.asDict()) for a in p["cleaning_actions_taken"]],
            list(p["warnings"]), p["blocking_issue"])
    e = r["eda_report"]
    if e is not None:
        run.eda_report = EDAReport({c["feature"]: c["corr"] for c in e["correlation_summary"]},
                                   [FeatureDecision(**d.asDict()) for d in e["engineered_features"]],
                                   [FeatureDecision(**d.asDict()) for d in e["dropped_features"]],
                                   list(e["leakage_warnings"]), list(e["data_quality_warnings"]),
                                   e["target_distribution_notes"], list(e["final_feature_names"]))
    t = r["tuning_result"]
    if t is not None:
        tr = _run_rows(spark, root, "trials", TRIALS_SCHEMA, run_id, heads).orderBy("trial_number")
        run.tuning_result = TuningResult(
            {k: parse_param_value(v) for k, v in t["best_params"].items()}, t["best_cv_score"], t["metric_optimized"],
            [TrialRecord(h["trial_number"], {k: parse_param_value(v) for k, v in h["params"].items()}, h["score"])
             for h in tr.collect()],
            t["converged"], t["search_budget_used"], t["search_budget_total"], t["convergence_notes"])
    v = r["evaluation_report"]
    if v is not None:
        fa = v["failure_analysis"]
        run.evaluation_report = EvaluationReport(
            dict(v["test_metrics"]), v["metric_optimized"], v["metric_value"], v["metric_threshold"], v["pass_fail"],
            None if v["confusion_matrix"] is None else [list(x) for x in v["confusion_matrix"]],
            None if v["residual_summary"] is None else dict(v["residual_summary"]),
            None if fa is None else FailureAnalysis(fa["summary"], fa["recommended_next_step"]), v["model_artifact_path"])
    hist = _run_rows(spark, root, "history", HISTORY_SCHEMA, run_id, heads).orderBy("seq").collect()
    run.history = [HistoryEntry(h["ts"].isoformat() if h["ts"] else "", h["stage"], h["event"]) for h in hist]
    tr = _run_rows(spark, root, "trace", TRACE_SCHEMA, run_id, heads).orderBy("seq").collect()
    run.trace = [TraceEntry(x["agent"], x["model"], x["prompt_tokens"], x["completion_tokens"], x["total_tokens"],
                            x["latency_ms"], x["estimated_cost_usd"], x["ts"].isoformat() if x["ts"] else None) for x in tr]
    return run


def run_list(spark: SparkSession, root: str) -> DataFrame:
    """Light summary of every run, newest first (J2 + sort)."""
    runs = _read(spark, root, "runs", RUNS_SCHEMA)
    return runs.select("run_id", "status", "loop_count", "created_at", "updated_at", "spec.task_type",
                       "spec.data_source", "spec.success_metric", "evaluation_report.metric_value",
                       "evaluation_report.pass_fail").orderBy(F.col("created_at").desc(), "run_id")
