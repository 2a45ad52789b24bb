import itertools
import math
import random

from tabml.operators import metrics as M
from tabml.operators.search import converged


def brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_roc_auc_matches_pairwise(spark):
    rng = random.Random(3)
    labels = [rng.randint(0, 1) for _ in range(400)]
    scores = [round(rng.random() * (0.6 + 0.4 * l), 2) for l in labels]   # many ties
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double").repartition(5)
    got = M.roc_auc(df, "label", "score").first()["roc_auc"]
    assert math.isclose(got, brute_auc(labels, scores), rel_tol=1e-12)


def test_macro_prf_with_label_only_predicted(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "x"), ("a", "a")]
    df = spark.createDataFrame(pairs, "y string, p string")
    r = M.macro_prf(df, "y", "p").first()
    # labels a, b, x: precision a=1, b=.5, x=0; recall a=2/3, b=.5, x=0
    assert math.isclose(r["precision"], 1.5 / 3) and math.isclose(r["recall"], (2 / 3 + 0.5) / 3)
    f1 = (2 * 2 / (3 + 2) + 2 * 1 / (2 + 2) + 0) / 3
    assert math.isclose(r["f1"], f1)
    assert M.macro_values(df, "y", "p")["f1"] == r["f1"]
    assert M.confusion_matrix(df, "y", "p") == [[2, 1, 0], [0, 1, 1], [0, 0, 0]]


def test_confusion_cells_per_group_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(f"g{rng.randint(0, 2)}", rng.choice("abc"), rng.choice("abcd")) for _ in range(300)]
    rows.append(("g3", None, "a"))   # a null actual is not a label
    df = spark.createDataFrame(rows, "g string, y string, p string").repartition(4)
    got = {(r["g"], r["actual"], r["predicted"]): (r["row_idx"], r["col_idx"], r["count"])
           for r in M.confusion_cells(df, "y", "p", ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        sub = [(y, p) for gg, y, p in rows if gg == g]
        labs = sorted({v for pair in sub for v in pair if v is not None})
        for i, a in enumerate(labs):
            for j, b in enumerate(labs):
                want[(g, a, b)] = (i, j, sum(1 for y, p in sub if (y, p) == (a, b)))
    assert got == want


def test_regression_metrics(spark):
    rows = [(float(2 * i + 1), float(2 * i + 1 + (1 if i % 2 else -1))) for i in range(120)]
    r = M.regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert math.isclose(r["rmse"], 1.0) and math.isclose(r["mae"], 1.0)
    assert math.isclose(r["residual_mean"], 0.0, abs_tol=1e-12) and math.isclose(r["residual_std"], 1.0)
    assert r["r2"] > 0.99


def test_r2_zero_variance_target(spark):
    r = M.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double"), "y", "p").first()
    assert r["r2"] == 1.0


def test_convergence_rule():
    assert converged([0.90] + [0.80] * 9) is True
    assert converged([0.50 + 0.01 * i for i in range(10)]) is False
    assert converged([0.80] * 8 + [0.95, 0.80]) is False


def test_macro_prf_large_count_table_path(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL_TABLE_ROWS", 0)
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "x"), ("a", "a")]
    r = M.macro_prf(spark.createDataFrame(pairs, "y string, p string"), "y", "p").first()
    assert math.isclose(r["precision"], 1.5 / 3) and math.isclose(r["recall"], (2 / 3 + 0.5) / 3)
