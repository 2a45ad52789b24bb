"""Search by cutting one forest a fold: against the forest's own predictions, a literal tree walk, and metrics of each trial alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabml.operators import metrics as M
from tabml.operators import search as SE
from tabml.operators import split as SP
from tabml.operators import train as T
from tabml.spec import PipelineConstraints, ProblemSpec


def noisy(spark, n=600, kind="int", seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.random(), rng.random()
        y = a + 0.5 * b * b + 0.3 * rng.random()
        rows.append((i, round(a, 3), round(b, 3), c, int(3 * y) % 3 if kind == "three" else int(y > 0.8) if kind == "int" else y))
    return spark.createDataFrame(rows, f"id long, a double, `b.x` double, c double, y {'double' if kind == 'real' else 'int'}")


FEATURES = ["a", "b.x", "c"]


def prepared(spark, kind):
    spec = ProblemSpec("regression" if kind == "real" else "classification", "y", "rmse" if kind == "real" else "f1", 0.5, "x.csv",
                       PipelineConstraints(max_tuning_trials=6))
    return SP.cv_folds(noisy(spark, kind=kind), spec, key="id"), spec


def literal(f, x, p):
    """One row, one trial, node by node."""
    total = np.zeros(f.value.shape[1])
    for root in f.roots[: p["n_estimators"]]:
        at, depth = root, 0
        while f.left[at] >= 0 and depth < p["max_depth"] and f.rows[at] >= p["min_samples_split"]:
            at, depth = (f.left if x[f.feature[at]] <= f.threshold[at] else f.right)[at], depth + 1
        total += f.value[at]
    return total / min(p["n_estimators"], len(f.roots))


@pytest.mark.parametrize("kind", ["int", "three", "real"])
def test_forest_equals_the_fitted_one_and_its_cuts_a_literal_walk(spark, kind):
    folded, spec = prepared(spark, kind)
    labels = T.class_labels(folded, "y") if spec.is_classification else None
    data = T.assembler(FEATURES).transform(T.with_safe_names(T.with_label(folded, spec, labels), FEATURES))
    model = T.forest(spec, {"n_estimators": 12, "max_depth": 9, "min_samples_split": 2}).fit(data)
    f = SE.read_forest(spark, model, len(labels) if labels else None)
    rows = model.transform(data).orderBy("id").collect()
    x = np.array([r[T.FEATURES].toArray() for r in rows])
    whole = f.trials(x, [{"n_estimators": 12, "max_depth": 9, "min_samples_split": 2}])[0]
    if labels:
        assert np.allclose(whole, [r["probability"].toArray() for r in rows]) and whole.argmax(1).tolist() == [r["prediction"] for r in rows]
    else:
        assert np.allclose(whole[:, 0], [r["prediction"] for r in rows])
    params = [{"n_estimators": n, "max_depth": d, "min_samples_split": m} for n, d, m in ((12, 3, 2), (5, 9, 40), (1, 1, 2), (12, 0, 2), (7, 20, 601), (30, 5, 9))]
    got = f.trials(x[:40], params)
    for i, p in enumerate(params):
        assert np.allclose(got[i], [literal(f, v, p) for v in x[:40]])
    assert len(f.roots) == 12 and (f.rows[f.roots] > 300).all()


@pytest.mark.parametrize("kind,metric", [("int", "f1"), ("int", "roc_auc"), ("int", "accuracy"), ("three", "precision"), ("real", "rmse"), ("real", "r2")])
def test_scores_of_all_trials_equal_each_alone(spark, kind, metric):
    folded, spec = prepared(spark, kind)
    spec = spec.replace(success_metric=metric)
    params = [{"n_estimators": 4, "max_depth": 2, "min_samples_split": 2}, {"n_estimators": 9, "max_depth": 6, "min_samples_split": 30}]
    labels = T.class_labels(folded, "y") if spec.is_classification else None
    data = T.assembler(FEATURES).transform(T.with_safe_names(T.with_label(folded, spec, labels), FEATURES)).cache()
    forests, want = {}, {}
    for fold in range(3):
        f = SE.read_forest(spark, T.forest(spec, {"n_estimators": 9, "max_depth": 6, "min_samples_split": 2}).fit(
            data.select(T.FEATURES, T.LABEL, "fold").where(F.col("fold") != fold)), len(labels) if labels else None)
        forests[fold] = f
        held = data.where(F.col("fold") == fold).collect()
        for i, v in enumerate(f.trials(np.array([r[T.FEATURES].toArray() for r in held]), params)):
            y = np.array([r[T.LABEL] for r in held])
            pred = v.argmax(1) if labels else v[:, 0]
            one = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, pred, v[:, -1])], "y double, p double, s double")
            want[i, fold] = M.grouped_metric(one, metric, "y", "p", "s").first()["score"]
    long = SE.trial_predictions(data, forests, params, spec.is_classification)
    assert long.count() == 2 * data.count()
    got = {(r["trial"], r["fold"]): r["score"] for r in M.grouped_metric(long, metric, "label", "prediction", "score", ["trial", "fold"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    scores = SE._cv(folded, spec, FEATURES, params)   # its own fits: rows may be bagged otherwise
    assert np.allclose(scores, [np.mean([want[i, f] for f in range(3)]) for i in range(2)], atol=0.1 if spec.is_classification else 0.15)


def test_labels_are_counted_inside_the_tasks(spark, monkeypatch):
    """Cells of all trials equal the counted long table; equal rows walk a tree once, whatever their number."""
    folded, spec = prepared(spark, "three")
    folded = folded.withColumn("a", F.round("a", 1)).withColumn("b.x", F.lit(1.0)).withColumn("c", F.round("c", 1))
    folded = folded.union(folded).union(folded).coalesce(1)
    params = [{"n_estimators": 4, "max_depth": 2, "min_samples_split": 2}, {"n_estimators": 9, "max_depth": 6, "min_samples_split": 30}]
    labels = T.class_labels(folded, "y")
    data = T.assembler(FEATURES).transform(T.with_safe_names(T.with_label(folded, spec, labels), FEATURES)).cache()
    forests = {f: SE.read_forest(spark, T.forest(spec, {"n_estimators": 9, "max_depth": 6, "min_samples_split": 2}).fit(
        data.select(T.FEATURES, T.LABEL, "fold").where(F.col("fold") != f)), 3) for f in range(3)}
    long = SE.trial_predictions(data, forests, params, True).groupBy("trial", "fold", "label", "prediction").count()
    for block in (SE.BLOCK_VALUES, 600):
        monkeypatch.setattr(SE, "BLOCK_VALUES", block)
        cells = SE.trial_cells(data, forests, params)
        assert sorted(map(tuple, cells.groupBy("trial", "fold", "label", "prediction").sum("n").collect())) == sorted(map(tuple, long.collect()))
        if block > 600:
            assert cells.agg(F.sum("n")).first()[0] == 2 * data.count() and cells.count() <= 2 * 3 * 9
    for m in M.LABEL_METRICS:
        one = M.grouped_metric(SE.trial_predictions(data, forests, params, True), m, "label", "prediction", group=["trial", "fold"])
        got = M.grouped_metric(cells, m, "label", "prediction", group=["trial", "fold"], weight="n")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, got.collect()))


def test_search_fits_one_forest_a_fold(spark, monkeypatch):
    folded, spec = prepared(spark, "int")
    made = []
    real = T.forest
    monkeypatch.setattr(T, "forest", lambda spec, params, *a, **k: made.append(params) or real(spec, {**params, "n_estimators": 6}, *a, **k))
    got = SE.tune_hyperparameters(folded, spec, FEATURES)
    assert len(made) == 3 and len(got.search_history) == got.search_budget_used == 6
    assert made[0]["max_depth"] == max(t.params["max_depth"] for t in got.search_history)
    assert got.best_cv_score == max(t.score for t in got.search_history) > 0.6


def test_names_with_dots_reach_the_verdict(spark):
    spec = ProblemSpec("classification", "y", "f1", 0.1, "x.csv")
    df = noisy(spark).withColumn("is_test", F.col("id") % 5 == 0)
    from tabml.reports import TuningResult
    _, report, preds = T.train_and_evaluate(df, spec, TuningResult({"n_estimators": 5, "max_depth": 4}, 0.5, "f1_macro"), FEATURES)
    assert report.pass_fail == "pass" and preds.count() == 120


def test_unknown_metric_is_an_error(spark):
    with pytest.raises(ValueError, match="cross-validated"):
        M.fold_metric(noisy(spark), "speed", "y", "y")


def test_grouped_auc_against_all_pairs(spark):
    rng = random.Random(12)
    rows = []
    for g in ["a", "b", None, "one class", "tied"]:
        for _ in range(400 if g == "a" else 60):
            s = 0.5 if g == "tied" else rng.choice([None, float("nan"), round(rng.random(), 1 if g == "b" else 6)]) if rng.random() < 0.1 else round(rng.random(), 2)
            rows.append((g, 1 if g == "one class" else rng.randrange(2), s))
    df = spark.createDataFrame(rows, "g string, y int, s double").repartition(7)
    key = lambda s: (1, 0) if s != s else (0, s)  # noqa: E731 - NaN is the largest score

    def pairs(sub):
        pos, neg = [key(s) for y, s in sub if y == 1 and s is not None], [key(s) for y, s in sub if y == 0 and s is not None]
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    want = {g: pairs([(y, s) for h, y, s in rows if h == g]) for g in {r[0] for r in rows}}
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, "y", "s", group=["g"]).collect()}
    assert set(got) == set(want) and all((got[g] is None) == (want[g] is None) and (want[g] is None or abs(got[g] - want[g]) < 1e-12) for g in want)
    assert abs(M.roc_auc(df, "y", "s").first()["roc_auc"] - pairs([(y, s) for _, y, s in rows])) < 1e-12
    assert M.roc_auc(df.where("false"), "y", "s").first()["roc_auc"] is None and M.roc_auc(df.where("false"), "y", "s", group=["g"]).count() == 0
