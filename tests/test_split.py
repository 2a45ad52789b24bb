from pyspark.sql import functions as F

from tabml.operators import split as SP
from tabml.spec import ProblemSpec

CLS = ProblemSpec("classification", "y", "f1", 0.8, "x.parquet")
REG = ProblemSpec("regression", "y", "r2", 0.8, "x.parquet")


def strat_df(spark):
    return spark.createDataFrame([(i, float(i), 1 if i >= 180 else 0) for i in range(200)], "id long, a double, y int")


def test_stratified_exact_and_repeatable(spark):
    df = strat_df(spark)
    s1 = SP.train_test_split(df, CLS, key="id")
    s2 = SP.train_test_split(df, CLS, key="id")
    assert s1.where("is_test and y = 1").count() == 4
    assert s1.where("is_test").count() == 40
    k1 = sorted(r[0] for r in s1.where("is_test").select("id").collect())
    k2 = sorted(r[0] for r in s2.where("is_test").select("id").collect())
    assert k1 == k2


def test_bucketed_equals_window(spark):
    df = strat_df(spark)
    for spec in (CLS, REG):
        a = SP.train_test_split(df, spec, key="id").where("is_test").select("id").collect()
        b = SP.train_test_split(df, spec, key="id", method="window").where("is_test").select("id").collect()
        assert sorted(a) == sorted(b)
        fa = SP.cv_folds(df, spec, key="id").select("id", "fold").collect()
        fb = SP.cv_folds(df, spec, key="id", method="window").select("id", "fold").collect()
        assert sorted(fa) == sorted(fb)


def test_split_disjoint_and_complete(spark):
    df = strat_df(spark)
    s = SP.train_test_split(df, CLS, key="id")
    assert s.count() == 200 and s.select("id").distinct().count() == 200


def test_fold_sizes_within_one_per_class(spark):
    f = SP.cv_folds(strat_df(spark), CLS, key="id")
    for y in (0, 1):
        sizes = [r["count"] for r in f.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1


def test_quotas_largest_remainder():
    assert SP.test_quotas({0: 180, 1: 20}) == {0: 36, 1: 4}
    q = SP.test_quotas({"a": 3, "b": 3, "c": 1})
    assert sum(q.values()) == 2


def test_train_only_median(spark):
    rows = [(i, None if i % 7 == 0 else float((i + 1) ** 2), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, x double, y int")
    out, fills = SP.split_and_clean(df, CLS, key="row_id")
    import numpy as np
    train_vals = [r["x"] for r in SP.train_test_split(SP.prepare_for_split(df, CLS), CLS, key="row_id")
                  .where("not is_test and x is not null").collect()]
    assert fills["x"] == float(np.median(train_vals))
    assert out.where("x is null").count() == 0


def test_quota_table_matches_driver_rule(spark):
    import random
    rng = random.Random(9)
    for trial in range(6):
        k = rng.randint(1, 7)
        counts = {f"c{i}": rng.choice([1, 2, 3, 5, 10, rng.randint(1, 5000)]) for i in range(k)}
        cells = spark.createDataFrame([(g, 0, n) for g, n in counts.items()], f"{SP.GROUP} string, {SP.BUCKET} int, n long")
        got = {r[SP.GROUP]: r["__quota"] for r in SP.quota_table(cells, stratified=True).collect()}
        assert got == SP.test_quotas(counts), counts
    one = spark.createDataFrame([(0, 0, 7), (0, 1, 9)], f"{SP.GROUP} int, {SP.BUCKET} int, n long")
    assert SP.quota_table(one, stratified=False).collect()[0]["__quota"] == 4   # ceil(0.2 * 16)


def test_too_many_classes_fails(spark, monkeypatch):
    import pytest
    monkeypatch.setattr(SP, "MAX_BROADCAST_GROUPS", 2)
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, y int")
    with pytest.raises(Exception, match="too many for a stratified split"):
        SP.train_test_split(df, ProblemSpec("classification", "y", "f1", 0.8, "builtin:orders_status"), key="id").count()


def test_cached_and_single_plan_paths_agree(spark):
    import random
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "c"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y string")
    spec = ProblemSpec("classification", "y", "f1", 0.8, "x.parquet")
    lazy = sorted(r[0] for r in SP.train_test_split(df, spec, key="id").where("is_test").select("id").collect())
    cached = df.persist()
    eager = sorted(r[0] for r in SP.train_test_split(cached, spec, key="id").where("is_test").select("id").collect())
    cached.unpersist()
    assert lazy == eager and len(lazy) == 600


def test_regression_split_and_folds_use_no_nested_loop_join(spark):
    df = strat_df(spark)
    for out in (SP.train_test_split(df, REG, key="id"), SP.train_test_split(df.persist(), REG, key="id"),
                SP.cv_folds(df, REG, key="id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert SP.train_test_split(df, REG, key="id").where("is_test").count() == 40


def test_folds_equal_the_window_form_with_many_digits(spark, monkeypatch):
    """Cells of about two rows need several digit groups; nulls in other columns and repeated feature values do not matter."""
    import random
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "b", "b"]), rng.choice([None, 1.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y string, x double").repartition(5)
    spec = ProblemSpec("classification", "y", "f1", 0.8, "x.parquet")
    want = sorted((r["id"], r["fold"]) for r in SP.cv_folds(df, spec, key="id", method="window").collect())
    monkeypatch.setattr(SP, "BUCKET_HEX_DIGITS", 1)   # groups of one digit: three levels
    monkeypatch.setattr(SP, "CELL_ROWS", 2)
    assert SP.fold_digits(3000) == 3
    assert sorted((r["id"], r["fold"]) for r in SP.cv_folds(df, spec, key="id").collect()) == want
    lazy = sorted(r["id"] for r in SP.train_test_split(df, spec, key="id").where("is_test").collect())
    assert lazy == sorted(r["id"] for r in SP.train_test_split(df, spec, key="id", method="window").where("is_test").collect())
    assert [SP.fold_digits(n) for n in (0, 32, 33, 512, 513)] == [1, 1, 2, 2, 3]


def test_cells_stay_bounded_on_equal_feature_rows(spark):
    """20,000 rows with the same features and label: the row key deals them over cells, and no cell is large."""
    df = spark.range(20_000).select("id", F.lit(1.0).alias("x"), F.lit("a").alias("y"))
    spec = ProblemSpec("classification", "y", "f1", 0.8, "x.parquet")
    split = SP.with_row_key(SP.train_test_split(SP.prepare_for_split(df, spec), spec))
    X = split.select("x", "y", SP.ROW_KEY, "is_test")
    assert X.where("is_test").count() == 4000
    folds = SP.cv_folds(X.where("not is_test"), spec, key=SP.ROW_KEY)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [5333, 5333, 5334]
    cells = SP.with_hash_order(X, SP.ROW_KEY).groupBy(F.substring(SP.HASH, 1, SP.fold_digits(16_000))).count()
    assert cells.agg(F.max("count")).first()[0] < 2 * SP.CELL_ROWS


def test_empty_split_and_folds(spark):
    df = strat_df(spark).where("false")
    for spec in (CLS, REG):
        assert SP.train_test_split(df, spec, key="id").count() == SP.cv_folds(df, spec, key="id").count() == 0
