import numpy as np

from tabml.operators.stats import exact_quantiles


def test_exact_quantiles_both_paths_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 3000).round(3), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    want = np.quantile(vals, probs)
    a = exact_quantiles(df, ["x"], probs)["x"]
    b = exact_quantiles(df, ["x"], probs, max_percentile_rows=10)["x"]   # force the narrowing search
    assert np.allclose(a, want) and np.allclose(b, want)


def test_quantiles_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5], max_percentile_rows=0)["x"] == [None]


def test_batched_rank_search_many_rounds(spark, monkeypatch):
    """All columns narrow together; tiny buckets force many rounds, ties and skewed spacing included."""
    from tabml.operators import stats as ST
    monkeypatch.setattr(ST, "HIST_BUCKETS", 4)
    monkeypatch.setattr(ST, "FINAL_RANGE_ROWS", 3)
    rng = np.random.default_rng(5)
    n = 1500
    cols = {
        "a": rng.normal(10, 3, n).round(2),
        "b": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n)).astype(float),   # a hot value
        "c": 2.0 ** rng.integers(0, 60, n),                                                # exponential spacing
        "d": rng.integers(-1000, 1000, n).astype(float),
    }
    rows = [tuple(float(cols[k][i]) for k in cols) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, list(cols), probs, max_percentile_rows=0)
    for k, v in cols.items():
        assert np.allclose(got[k], np.quantile(v, probs), rtol=1e-12), k
