"""Flat-argument stage tools (the reference's extension points) with M11 reuse.

Each tool can run alone from a data source, or reuse earlier results of the same run from a
``RunCache`` (this session) or ``DurableCache`` (any session) -- only when every piece it needs is
present; otherwise it recomputes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.operators import features as FE
from tabml.operators import profile as P
from tabml.operators import search as SE
from tabml.operators import split as SP
from tabml.operators import train as T
from tabml.plans.cache import DurableCache, RunCache  # noqa: F401
from tabml.plans.pipeline import PipelineBlockedError
from tabml.reports import DataProfile, EDAReport, EvaluationReport, TuningResult
from tabml.sources.files import load_data
from tabml.spec import PipelineConstraints, ProblemSpec


def _spec(data_source, target_column, task_type, success_metric=None, metric_threshold=0.0, trials=None):
    metric = success_metric or ("f1" if task_type == "classification" else "r2")
    return ProblemSpec(task_type, target_column, metric, metric_threshold, data_source,
                       PipelineConstraints(max_tuning_trials=trials))


def profile_dataset_tool(spark: SparkSession, data_source: str, target_column: str, task_type: str,
                         cache: RunCache | None = None, run_id: str | None = None, base_dir: str | None = None
                         ) -> DataProfile:
    spec = _spec(data_source, target_column, task_type)
    deduped, cleaned, profile = P.clean_profile_parts(load_data(spark, spec, base_dir), spec, impute=True)
    if profile.blocking_issue:
        raise PipelineBlockedError("data_agent", profile.blocking_issue)
    if cache is not None:
        cache.put(run_id, profile=profile, deduped=deduped, cleaned=cleaned)
    return profile


def engineer_features_tool(spark: SparkSession, data_source: str, target_column: str, task_type: str,
                           cache: RunCache | None = None, run_id: str | None = None,
                           profile: DataProfile | None = None, base_dir: str | None = None) -> EDAReport:
    spec = _spec(data_source, target_column, task_type)
    got = cache.get(run_id, "deduped", "profile") if cache is not None else None
    if got is None:
        deduped, _, prof = P.clean_profile_parts(load_data(spark, spec, base_dir), spec, impute=False)
    else:
        deduped, prof = got
    profile = profile or prof
    if profile.blocking_issue:
        raise PipelineBlockedError("feature_agent", profile.blocking_issue)
    split, _ = SP.split_and_clean(deduped, spec, prepared=True)
    split = SP.with_row_key(split)
    est = FE.FeatureSelector(spec, exclude=("is_test", SP.ROW_KEY), profile=profile)
    model = est.fit(split.where(~F.col("is_test")))
    X = model.transform(split).persist()
    if cache is not None:
        cache.put(run_id, X=X, features=model.plan.final_feature_names, plan=model.plan, eda=est.report)
    return est.report


def _features(spark, data_source, target_column, task_type, cache, run_id, base_dir):
    got = cache.get(run_id, "X", "features") if cache is not None else None
    if got is None:
        c = cache if cache is not None else RunCache()
        rid = run_id or "__local"
        engineer_features_tool(spark, data_source, target_column, task_type, c, rid, base_dir=base_dir)
        got = c.get(rid, "X", "features")
    return got


def tune_model_tool(spark: SparkSession, data_source: str, target_column: str, task_type: str,
                    cache: RunCache | None = None, run_id: str | None = None, max_tuning_trials: int = 25,
                    success_metric: str | None = None, base_dir: str | None = None) -> TuningResult:
    spec = _spec(data_source, target_column, task_type, success_metric, trials=max_tuning_trials)
    X, feats = _features(spark, data_source, target_column, task_type, cache, run_id, base_dir)
    folds = SP.cv_folds(X.where(~F.col("is_test")).drop("is_test"), spec, key=SP.ROW_KEY).persist()
    result = SE.tune_hyperparameters(folds, spec, feats, n_trials=max_tuning_trials)
    folds.unpersist()
    if cache is not None:
        cache.put(run_id, tuning=result)
    return result


def train_and_evaluate_tool(spark: SparkSession, data_source: str, target_column: str, task_type: str,
                            success_metric: str, metric_threshold: float, cache: RunCache | None = None,
                            run_id: str | None = None, tuning_result: TuningResult | None = None,
                            base_dir: str | None = None) -> EvaluationReport:
    spec = _spec(data_source, target_column, task_type, success_metric, metric_threshold)
    X, feats = _features(spark, data_source, target_column, task_type, cache, run_id, base_dir)
    if tuning_result is None:
        got = cache.get(run_id, "tuning") if cache is not None else None
        tuning_result = got[0] if got else tune_model_tool(spark, data_source, target_column, task_type, cache,
                                                           run_id, success_metric=success_metric, base_dir=base_dir)
    _, report, _ = T.train_and_evaluate(X, spec, tuning_result, feats)
    return report
