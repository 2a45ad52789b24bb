"""Stage results that outlive the session: what is reused, what is computed again."""

import glob
import json
import os

import pytest

from tabml.operators import features as FE
from tabml.operators import profile as P
from tabml.operators import search as SE
from tabml.plans import pipeline as PL
from tabml.plans.cache import DurableCache, digest, source_version
from tabml.reports import DataProfile, build
from tabml.sources.views import orders_labeled, table
from tabml.spec import PipelineConstraints, ProblemSpec


class Killed(Exception):
    pass


def spec(**kw):
    return ProblemSpec("classification", "is_p", "f1", 0.9, "builtin:orders_status", PipelineConstraints(max_tuning_trials=kw.get("trials", 3)))


def kill_at(status):
    def on_update(run):
        if run.status == status:
            raise Killed
    return on_update


def count_stages(monkeypatch):
    calls = []
    for mod, name in ((P, "clean_profile_parts"), (FE, "fit_plan"), (SE, "tune_hyperparameters")):
        real = getattr(mod, name)
        monkeypatch.setattr(mod, name, lambda *a, _r=real, _n=name, **k: calls.append(_n) or _r(*a, **k))
    return calls


def test_killed_after_tuning_resumes_at_training(spark, sf, tmp_path, monkeypatch):
    calls, root = count_stages(monkeypatch), str(tmp_path / "stages")
    start = lambda on=None, **kw: PL.run_pipeline(spark, spec(**kw), run_id="r", df=orders_labeled(spark, sf), key="o_orderkey", on_update=on,
                                                  cache=DurableCache(spark, root))
    with pytest.raises(Killed):
        start(kill_at("tuned"))
    assert calls == ["clean_profile_parts", "fit_plan", "tune_hyperparameters"]
    run = start()   # a cache object of its own, as in another session
    assert calls == ["clean_profile_parts", "fit_plan", "tune_hyperparameters"]
    assert run.status == "done" and run.evaluation_report.metric_value == 1.0 and len(run.tuning_result.search_history) == 3
    assert [h.event for h in run.history if "stored" in h.event] == [f"stored result of stage {s} used" for s in ("data", "features", "tuning")]
    fresh = PL.run_pipeline(spark, spec(), run_id="r", df=orders_labeled(spark, sf), key="o_orderkey")
    del calls[:]
    assert fresh.eda_report == run.eda_report and fresh.data_profile == run.data_profile
    assert start(trials=4).tuning_result.search_budget_total == 4 and calls == ["tune_hyperparameters"]   # another budget: that stage only


def test_killed_before_tuning_and_a_lost_piece(spark, sf, tmp_path, monkeypatch):
    calls, root = count_stages(monkeypatch), str(tmp_path / "stages")
    start = lambda on=None: PL.run_pipeline(spark, spec(), run_id="r", df=orders_labeled(spark, sf), key="o_orderkey", on_update=on,
                                            cache=DurableCache(spark, root))
    with pytest.raises(Killed):
        start(kill_at("features_ready"))
    (part, *_) = glob.glob(f"{root}/*/split-*/part-*")
    os.truncate(part, os.path.getsize(part) - 1)
    del calls[:]
    assert start().status == "done" and calls == ["clean_profile_parts", "tune_hyperparameters"]   # the broken frame again, the plan not


def test_a_put_without_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    cache = DurableCache(spark, root)
    cache.put("r", X=spark.range(3), features=["a"])
    monkeypatch.setattr(DurableCache, "_commit", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        DurableCache(spark, root).put("r", X=spark.range(9), features=["a", "b"])
    monkeypatch.undo()
    x, features = DurableCache(spark, root).get("r", "X", "features")
    assert x.count() == 3 and features == ["a"]
    cache.put("r", X=spark.range(5))
    assert cache.get("r", "X")[0].count() == 5 and cache.get("r", "X", "none") is None and cache.get("q", "X") is None and cache.get(None, "X") is None


def test_digest_follows_source_and_spec(spark, sf, tmp_path):
    a = str(tmp_path / "a")
    spark.range(5).write.parquet(a)
    one = source_version(spark.read.parquet(a))
    assert source_version(spark.read.parquet(a)) == one
    spark.range(6).write.mode("append").parquet(a)
    assert source_version(spark.read.parquet(a)) != one
    assert digest("a", 1) != digest("a", 2) and digest({"x": 1, "y": 2}) == digest({"y": 2, "x": 1})


def test_reports_from_their_plain_form(spark, sf):
    _, prof = P.clean_and_profile(table(spark, sf, "orders"), ProblemSpec("classification", "o_orderstatus", "f1", 0.8, "x.csv"))
    plain = json.loads(prof.to_json())
    assert build(DataProfile, {**plain, "unknown": 1}) == prof and build(DataProfile, None) is None
