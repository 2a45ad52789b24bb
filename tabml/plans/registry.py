"""Checked queries: each takes (spark, sf_dir), reads whole tables of that folder and returns a
DataFrame; ``ORACLE`` holds the DuckDB form of each (absent = rows-only check)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.functions.dates import datetime_parts
from tabml.functions.dtypes import column_classes_frame, numeric_columns
from tabml.functions.missing import is_missing, nullify
from tabml.operators import features as FE
from tabml.operators import metrics as M
from tabml.operators import profile as P
from tabml.operators import split as SP
from tabml.plans import sqlkit as Q
from tabml.session import scratch_path
from tabml.sources import files as SRC
from tabml.sources import views as V
from tabml.spec import ProblemSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def _spec(task: str, target: str, metric: str | None = None, source: str = "builtin:orders_status") -> ProblemSpec:
    metric = metric or ("f1" if task == "classification" else "r2")
    return ProblemSpec(task, target, metric, 0.8, source)


FLAG_SPEC = _spec("classification", "is_p")

# vocabularies of the testdata columns used by the SQL forms (the Spark side learns them)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]

# ====================================================================== sources

@query("scan_parquet", "SELECT * FROM orders")
def q_scan_parquet(spark, sf):
    spec = _spec("classification", "o_orderstatus", source=os.path.join(sf, "orders.parquet"))
    return SRC.load_data(spark, spec)


@query("scan_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
                   "FROM customer")
def q_scan_csv(spark, sf):
    path = scratch_path(spark, "customer-csv") + ".csv"
    V.table(spark, sf, "customer").write.option("header", True).csv(path)
    spec = _spec("classification", "c_mktsegment", source=path)
    return SRC.load_data(spark, spec)


@query("scan_builtin", "SELECT *, CAST(o_orderstatus = 'P' AS INTEGER) AS diagnosis FROM orders")
def q_scan_builtin(spark, sf):
    return SRC.scan_builtin(spark, "builtin:orders_status", SRC.BUILTIN_TARGET_NAME, base_dir=sf)


@query("target_rename", "SELECT *, CAST(o_orderstatus = 'P' AS INTEGER) AS churned FROM orders")
def q_target_rename(spark, sf):
    return SRC.load_data(spark, _spec("classification", "churned", source="builtin:orders_status"), base_dir=sf)


@query("source_valid", "SELECT page_id, url, (url LIKE '%.csv' OR url LIKE '%.parquet' OR url IN ("
       + ", ".join(f"'builtin:{n}'" for n in SRC.BUILTINS) + ")) AS is_valid FROM pages")
def q_source_valid(spark, sf):
    p = V.table(spark, sf, "pages")
    return p.select("page_id", "url", SRC.source_valid_expr(F.col("url")).alias("is_valid"))


@query("dataset_catalog")
def q_dataset_catalog(spark, sf):
    return SRC.dataset_catalog(spark, sf).select("source", "label", "task_type", "ord")


# ====================================================================== predicates / projections

@query("is_missing", Q.compose("SELECT o_orderkey, o_totalprice IS NULL OR isnan(o_totalprice) AS price_missing, "
                               "o_orderpriority IS NULL AS priority_missing FROM gaps", ("gaps",)))
def q_is_missing(spark, sf):
    g = V.gaps(spark, sf)
    dt = {f.name: f.dataType for f in g.schema.fields}
    return g.select("o_orderkey", is_missing("o_totalprice", dt["o_totalprice"]).alias("price_missing"),
                    is_missing("o_orderpriority", dt["o_orderpriority"]).alias("priority_missing"))


# fixed values: DuckDB type names and the Spark type names they read back as
_DUCK_TO_SPARK_TYPE = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint' "
                       "WHEN 'TINYINT' THEN 'tinyint' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' "
                       "WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
                       "WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'DATE' THEN 'date' ELSE lower(column_type) END")


@query("column_classes", (
    "SELECT column_name, CASE WHEN dtype = 'boolean' THEN 'bool' "
    "WHEN dtype IN ('bigint', 'int', 'smallint', 'tinyint', 'double', 'float') OR dtype LIKE 'decimal%' THEN 'numeric' "
    "WHEN dtype IN ('timestamp_ntz', 'timestamp', 'date') THEN 'datetime' WHEN dtype = 'string' THEN 'categorical' "
    "ELSE 'other' END AS column_class, dtype, CAST(position AS INTEGER) AS position FROM "
    f"(SELECT column_name, {_DUCK_TO_SPARK_TYPE} AS dtype, row_number() OVER () - 1 AS position FROM "
    f"(DESCRIBE (WITH flagged AS ({V.SQL_VIEWS['flagged']}) SELECT * FROM flagged))) d"))
def q_column_classes(spark, sf):
    return column_classes_frame(spark, V.flagged(spark, sf))


@query("numeric_select", Q.compose("SELECT o_orderkey, o_custkey, constant_flag, leaked FROM flagged", ("flagged",)))
def q_numeric_select(spark, sf):
    df = V.flagged(spark, sf)
    return df.select(*numeric_columns(df, exclude=("o_totalprice",)))


@query("drop_missing_target", Q.compose("SELECT * FROM gaps WHERE o_orderpriority IS NOT NULL", ("gaps",)))
def q_drop_missing_target(spark, sf):
    return P.drop_missing_target(V.gaps(spark, sf), "o_orderpriority")


_BLOCK_VIEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS y FROM orders"


@query("target_missing_block", Q.compose(
    "SELECT count(*) AS row_count, round(avg(CAST(y IS NULL AS INTEGER)), 6) AS missing_share, "
    "avg(CAST(y IS NULL AS INTEGER)) > 0.5 AS blocked FROM bv", ctes=[("bv", _BLOCK_VIEW)]))
def q_target_missing_block(spark, sf):
    o = V.table(spark, sf, "orders")
    df = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, None).otherwise(F.col("o_totalprice")).alias("y"))
    n, m = P.target_missing_counts(df, "y")
    share = m / n if n else 0.0
    return spark.createDataFrame([(n, round(share, 6), P.target_block_message(share, "y") is not None)],
                                 "row_count long, missing_share double, blocked boolean")


@query("xy_project", Q.compose("SELECT o_orderkey, o_totalprice, leaked, is_large, is_p AS label FROM fv",
                               ctes=[("fv", "SELECT *, CAST(o_totalprice * 2 + 1 AS DOUBLE) AS leaked, "
                                            "o_totalprice > 100000 AS is_large, CAST(o_orderstatus = 'P' AS INTEGER) AS is_p "
                                            "FROM orders")]))
def q_xy_project(spark, sf):
    df = V.flagged(spark, sf).withColumn("is_p", (F.col("o_orderstatus") == "P").cast("int"))
    return df.select("o_orderkey", "o_totalprice", "leaked", "is_large", F.col("is_p").alias("label"))


@query("bool_cast", Q.compose("SELECT o_orderkey, CAST(is_large AS INTEGER) AS is_large FROM flagged", ("flagged",)))
def q_bool_cast(spark, sf):
    return V.flagged(spark, sf).select("o_orderkey", F.col("is_large").cast("int").alias("is_large"))


@query("align_columns", "SELECT o_orderkey, " + ", ".join(
    f'{Q.dummy_expr("o_orderpriority", v)} AS "o_orderpriority_{v}"' for v in PRIORITIES[:4]) + " FROM orders")
def q_align_columns(spark, sf):
    """Vocabulary learned on the rows without '5-LOW', replayed on all rows: the unseen value gets zeros."""
    o = V.table(spark, sf, "orders")
    _, vocab = FE._vocabularies(o.where(F.col("o_orderpriority") != "5-LOW"), ["o_orderpriority"])
    plan = FE.FeaturePlan(target="none", categorical=vocab, source_order=["o_orderpriority"],
                          keep_cols=[FE.dummy_name("o_orderpriority", v) for v in vocab["o_orderpriority"]])
    return o.select("o_orderkey", *FE.feature_columns(plan))


# ====================================================================== aggregations

@query("row_col_count", Q.compose("SELECT count(*) AS row_count, 6 AS column_count FROM (SELECT DISTINCT * FROM duplicates)",
                                  ("duplicates",)))
def q_row_col_count(spark, sf):
    d = P.dedup_rows(V.duplicates(spark, sf))
    return d.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(d.columns)).alias("column_count"))


def _missing_sql(view: str, cols: list[str], float_cols: tuple[str, ...] = ()) -> str:
    parts = []
    for i, c in enumerate(cols):
        m = f"({c} IS NULL OR isnan({c}))" if c in float_cols else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS column_name, round(avg(CAST({m} AS INTEGER)) * 100, 2) AS missing_pct, "
                     f"{i} AS position FROM {view}")
    return " UNION ALL ".join(parts)


GAPS_COLS = ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"]


@query("missing_pct", Q.compose(_missing_sql("gaps", GAPS_COLS, ("o_totalprice",)), ("gaps",)))
def q_missing_pct(spark, sf):
    return P.missing_pct_table(V.gaps(spark, sf))


PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("distinct_count", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM part" for c in PART_COLS))
def q_distinct_count(spark, sf):
    return P.distinct_counts_table(V.table(spark, sf, "part"))


_PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
               "p_size": "int", "p_retailprice": "double"}


@query("peek_columns", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS column_name, '{_PART_TYPES[c]}' AS dtype,
       round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS unique_count,
       (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM
          (SELECT DISTINCT {c} AS v FROM part WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS example_value
       FROM part""" for i, c in enumerate(PART_COLS)))
def q_peek_columns(spark, sf):
    t = P.peek_columns(spark, V.table(spark, sf, "part"))
    return t.select("position", "column_name", "dtype", "missing_pct", "unique_count",
                    F.array_join("example_value", "|").alias("example_value"))


@query("median_impute", Q.compose(
    "SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gaps)), 6) "
    "AS o_totalprice FROM gaps", ("gaps",)))
def q_median_impute(spark, sf):
    g = V.gaps(spark, sf)
    fills = P.median_fills(g, ["o_totalprice"])
    return P.apply_fills(g, fills).select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@query("mode_impute", Q.compose(
    "SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM gaps WHERE o_orderpriority IS NOT NULL "
    "GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM gaps", ("gaps",)))
def q_mode_impute(spark, sf):
    g = V.gaps(spark, sf)
    return P.apply_fills(g, P.mode_fills(g, ["o_orderpriority"])).select("o_orderkey", "o_orderpriority")


@query("class_balance", "SELECT o_orderstatus AS label, round(count(*) / sum(count(*)) OVER (), 4) AS share "
                        "FROM orders GROUP BY o_orderstatus")
def q_class_balance(spark, sf):
    return P.class_balance_table(V.table(spark, sf, "orders"), "o_orderstatus")


@query("imbalance_warning", Q.compose(
    "SELECT min(share) AS minority_share, min(share) < 0.1 AS warn FROM "
    "(SELECT rare, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM rare GROUP BY rare) t", ("rare",)))
def q_imbalance_warning(spark, sf):
    bal = P.class_balance_table(V.rare(spark, sf), "rare")
    return bal.agg(F.min("share").alias("minority_share"), (F.min("share") < 0.1).alias("warn"))


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _iqr_sql() -> str:
    parts = []
    for c in LI_NUM:
        parts.append(f"""SELECT '{c}' AS column_name, round(q[1], 6) AS q1, round(q[2], 6) AS q3,
  CASE WHEN q[2] - q[1] = 0 THEN NULL ELSE round((SELECT avg(CAST({c} < q[1] - 3 * (q[2] - q[1]) OR {c} > q[2] + 3 * (q[2] - q[1]) AS INTEGER)) FROM lineitem), 6) END AS outlier_share,
  CASE WHEN q[2] - q[1] = 0 THEN false ELSE (SELECT avg(CAST({c} < q[1] - 3 * (q[2] - q[1]) OR {c} > q[2] + 3 * (q[2] - q[1]) AS INTEGER)) FROM lineitem) > 0.02 END AS flagged
FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem) t""")
    return " UNION ALL ".join(parts)


@query("iqr_outliers", _iqr_sql())
def q_iqr_outliers(spark, sf):
    li = V.table(spark, sf, "lineitem")
    t = P.iqr_outliers_table(spark, li, LI_NUM)
    return t.select("column_name", r6("q1").alias("q1"), r6("q3").alias("q3"),
                    r6("outlier_share").alias("outlier_share"), "flagged")


@query("dedup_rows", Q.compose("SELECT DISTINCT * FROM duplicates", ("duplicates",)))
def q_dedup_rows(spark, sf):
    return P.dedup_rows(V.duplicates(spark, sf))


_PROFILE_VIEW = ("pv", "SELECT * FROM gaps UNION ALL SELECT * FROM gaps WHERE o_orderkey % 10 = 0")


@query("data_profile", Q.compose(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, '{t}' AS dtype, "
        f"round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 2) AS missing_pct, {str(c == 'o_orderstatus').lower()} AS is_target "
        f"FROM (SELECT DISTINCT * FROM pv)"
        for i, (c, t) in enumerate([("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_orderdate", "timestamp_ntz"),
                                    ("o_totalprice", "double"), ("o_orderpriority", "string")])),
    ("gaps",), [_PROFILE_VIEW]))
def q_data_profile(spark, sf):
    g = V.gaps(spark, sf)
    df = g.unionAll(g.where(F.col("o_orderkey") % 10 == 0))
    _, prof = P.clean_and_profile(df, _spec("classification", "o_orderstatus"))
    return P.profile_frame(spark, prof)


# ====================================================================== split / folds / imputation

@query("train_test_split", Q.compose("SELECT o_orderkey, is_p, is_test FROM sp", ("orders_labeled",),
                                     Q.split_ctes("orders_labeled", "o_orderkey", "is_p")))
def q_train_test_split(spark, sf):
    df = SP.prepare_for_split(V.orders_labeled(spark, sf), FLAG_SPEC)
    return SP.train_test_split(df, FLAG_SPEC, key="o_orderkey").select("o_orderkey", "is_p", "is_test")


@query("train_only_impute", Q.compose(
    """SELECT o_orderkey, is_test,
       round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM sp WHERE NOT is_test)), 6) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT o_orderpriority FROM sp WHERE NOT is_test AND o_orderpriority IS NOT NULL
                GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM sp""",
    ("gaps",), Q.split_ctes("gaps", "o_orderkey", "o_orderstatus")))
def q_train_only_impute(spark, sf):
    spec = _spec("classification", "o_orderstatus")
    out, _ = SP.split_and_clean(V.gaps(spark, sf), spec, key="o_orderkey")
    return out.select("o_orderkey", "is_test", r6("o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query("cv_folds", Q.compose("SELECT o_orderkey, is_p, fold FROM fo", ("orders_labeled",),
                             Q.split_ctes("orders_labeled", "o_orderkey", "is_p")
                             + [("tr", "SELECT o_orderkey, is_p FROM sp WHERE NOT is_test"),
                                ("fo", Q.folds_sql("tr", "o_orderkey", "is_p"))]))
def q_cv_folds(spark, sf):
    df = SP.train_test_split(SP.prepare_for_split(V.orders_labeled(spark, sf), FLAG_SPEC), FLAG_SPEC, key="o_orderkey")
    tr = df.where(~F.col("is_test")).select("o_orderkey", "is_p")
    return SP.cv_folds(tr, FLAG_SPEC, key="o_orderkey")


@query("cv_folds_regression", Q.compose("SELECT p_partkey, fold FROM fo",
                                        ctes=[("fo", Q.folds_sql("part", "p_partkey", None))]))
def q_cv_folds_regression(spark, sf):
    p = V.table(spark, sf, "part")
    return SP.cv_folds(p, _spec("regression", "p_retailprice"), key="p_partkey").select("p_partkey", "fold")


# ====================================================================== scalar functions

@query("datetime_parts", "SELECT o_orderkey, " + ", ".join(f'{e} AS "{n}"' for n, e in Q.date_part_exprs("o_orderdate"))
       + " FROM orders")
def q_datetime_parts(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", *datetime_parts("o_orderdate"))


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    [f'{Q.dummy_expr("o_orderstatus", v)} AS "o_orderstatus_{v}"' for v in STATUSES]
    + [f'{Q.dummy_expr("o_orderpriority", v)} AS "o_orderpriority_{v}"' for v in PRIORITIES]) + " FROM orders")
def q_one_hot(spark, sf):
    o = V.table(spark, sf, "orders")
    _, vocab = FE._vocabularies(o, ["o_orderstatus", "o_orderpriority"])
    plan = FE.FeaturePlan(target="none", categorical=vocab, source_order=list(vocab))
    plan.keep_cols = [n for n, _, _, _ in FE.candidate_columns(plan)]
    return o.select("o_orderkey", *FE.feature_columns(plan))


@query("target_to_float", "SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS y_float, "
                          "CAST(o_totalprice AS DOUBLE) AS price_float FROM orders")
def q_target_to_float(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").try_cast("double").alias("y_float"),
                    F.col("o_totalprice").try_cast("double").alias("price_float"))


# ====================================================================== features

_FLAG_COLS = [("o_orderstatus", "categorical", STATUSES), ("o_orderdate", "datetime", None),
              ("o_orderpriority", "categorical", PRIORITIES)]


def flagship(spark: SparkSession, sf: str) -> tuple[DataFrame, "FE.FeaturePlanModel", list[dict]]:
    """Which columns of orders predict o_orderstatus = 'P', and is any of them a leak?
    Scan -> drop/dedup -> split -> (train rows) date parts, one-hot, |r|, variance -> decisions."""
    split, _ = SP.split_and_clean(V.orders_labeled(spark, sf), FLAG_SPEC, key="o_orderkey")
    est = FE.FeatureSelector(FLAG_SPEC)
    model = est.fit(split.where(~F.col("is_test")))
    return split, model, est.decisions


@query("fit_features", Q.compose("SELECT * FROM fd", ("orders_labeled",),
                                 Q.split_ctes("orders_labeled", "o_orderkey", "is_p")
                                 + [("fd", Q.decisions_sql("sp", "is_p", ["o_orderkey", "o_custkey", "o_totalprice"],
                                                           _FLAG_COLS, where="NOT is_test"))]))
def q_fit_features(spark, sf):
    _, _, decisions = flagship(spark, sf)
    return FE.decisions_frame(spark, decisions)


def features_long(df: DataFrame, model: "FE.FeaturePlanModel", key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The replayed feature matrix in long form (row_key, extra..., feature, value)."""
    names = model.plan.final_feature_names
    m = FE.FeaturePlanModel(model.plan, passthrough=("row_key",) + tuple(extra))
    wide = m.transform(df.withColumn("row_key", F.col(key)))
    return wide.unpivot(["row_key", *extra], names, "feature", "value")


_FLAG_DECISIONS = Q.decisions_sql("sp", "is_p", ["o_orderkey", "o_custkey", "o_totalprice"], _FLAG_COLS,
                                  where="NOT is_test")


def _flag_long_sql(src: str, extra: list[str]) -> str:
    ctes, main = Q.features_long_sql(src, "o_orderkey", extra, ["o_orderkey", "o_custkey", "o_totalprice"], _FLAG_COLS)
    return Q.compose(main, ("orders_labeled",),
                     Q.split_ctes("orders_labeled", "o_orderkey", "is_p") + [("fd", _FLAG_DECISIONS)] + ctes)


@query("apply_features", _flag_long_sql("sp", ["is_test"]))
def q_apply_features(spark, sf):
    """M2: the plan fitted on train rows replayed on all rows, as (row_key, is_test, feature, value)."""
    split, model, _ = flagship(spark, sf)
    return features_long(split, model, "o_orderkey", ("is_test",))


_LI_COLS = [("l_returnflag", "categorical", ["A", "N", "R"]), ("l_linestatus", "categorical", ["F", "O"]),
            ("l_shipdate", "datetime", None)]


@query("target_corr", Q.compose("SELECT * FROM fd", ctes=[("fd", Q.decisions_sql(
    "lineitem", "l_extendedprice", [c for c in LI_NUM if c != "l_extendedprice"], _LI_COLS))]))
def q_target_corr(spark, sf):
    li = V.table(spark, sf, "lineitem")
    _, _, decisions = FE.fit_plan(li, _spec("regression", "l_extendedprice"))
    return FE.decisions_frame(spark, decisions)


_FLAGGED_NUM = ["o_orderkey", "o_custkey", "constant_flag", "leaked"]
_FLAGGED_COLS = [("o_orderstatus", "categorical", STATUSES), ("o_orderdate", "datetime", None),
                 ("o_orderpriority", "categorical", PRIORITIES), ("is_large", "bool", None)]


@query("near_zero_variance", Q.compose(
    "SELECT feature, decision FROM fd WHERE decision = 'dropped_low_variance'", ("flagged",),
    [("fd", Q.decisions_sql("flagged", "o_totalprice", _FLAGGED_NUM, _FLAGGED_COLS))]))
def q_near_zero_variance(spark, sf):
    _, _, d = FE.fit_plan(V.flagged(spark, sf), _spec("regression", "o_totalprice"))
    return FE.decisions_frame(spark, d).where("decision = 'dropped_low_variance'").select("feature", "decision")


@query("leakage_flag", Q.compose(
    "SELECT feature, corr, decision FROM fd WHERE decision = 'kept_leakage_warning'", ("flagged",),
    [("fd", Q.decisions_sql("flagged", "o_totalprice", _FLAGGED_NUM, _FLAGGED_COLS))]))
def q_leakage_flag(spark, sf):
    _, _, d = FE.fit_plan(V.flagged(spark, sf), _spec("regression", "o_totalprice"))
    return FE.decisions_frame(spark, d).where("decision = 'kept_leakage_warning'").select("feature", "corr", "decision")


@query("low_signal_drop", Q.compose(
    "SELECT feature, corr FROM fd WHERE decision = 'dropped_low_signal'", ("flagged",),
    [("fd", Q.decisions_sql("flagged", "o_totalprice", _FLAGGED_NUM, _FLAGGED_COLS))]))
def q_low_signal_drop(spark, sf):
    _, _, d = FE.fit_plan(V.flagged(spark, sf), _spec("regression", "o_totalprice"))
    return FE.decisions_frame(spark, d).where("decision = 'dropped_low_signal'").select("feature", "corr")


@query("top2_interaction", Q.compose(
    "SELECT feature, source_column FROM fd WHERE kind = 'interaction'", ("flagged",),
    [("fd", Q.decisions_sql("flagged", "o_totalprice", _FLAGGED_NUM, _FLAGGED_COLS))]))
def q_top2_interaction(spark, sf):
    _, _, d = FE.fit_plan(V.flagged(spark, sf), _spec("regression", "o_totalprice"))
    return FE.decisions_frame(spark, d).where("kind = 'interaction'").select("feature", "source_column")


@query("interaction", Q.compose(
    "SELECT o_orderkey, round(leaked * CAST(CAST(is_large AS INTEGER) AS DOUBLE), 6) AS value FROM flagged", ("flagged",)))
def q_interaction(spark, sf):
    """F4 on the flagged-orders regression fit: the product of its top two kept candidates."""
    df = V.flagged(spark, sf)
    plan, _, _ = FE.fit_plan(df, _spec("regression", "o_totalprice"))
    name, a, b = plan.interaction
    cands = {n: e for n, e, _, _ in FE.candidate_columns(plan)}
    return df.select("o_orderkey", r6(cands[a] * cands[b]).alias("value"))


_DT_GAPS = ("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, "
            "o_totalprice FROM orders")


@query("missing_datetime", Q.compose("SELECT 'o_orderdate' AS column_name, count(*) - count(o_orderdate) AS missing_count "
                                     "FROM dg", ctes=[("dg", _DT_GAPS)]))
def q_missing_datetime(spark, sf):
    o = V.table(spark, sf, "orders")
    dg = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
                  "o_totalprice")
    _, rep, _ = FE.fit_plan(dg, _spec("regression", "o_totalprice"))
    return spark.createDataFrame(sorted(rep.missing_datetimes.items()), "column_name string, missing_count long")


# ====================================================================== metrics

@query("confusion_matrix", Q.compose(
    """SELECT l1.lbl AS actual, l2.lbl AS predicted, CAST(l1.idx AS INTEGER) AS row_idx, CAST(l2.idx AS INTEGER) AS col_idx,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
       FROM lab l1 CROSS JOIN lab l2 LEFT JOIN cnt c ON c.actual = l1.lbl AND c.predicted = l2.lbl""",
    ("multiclass_predictions",),
    [("cnt", "SELECT actual, predicted, count(*) AS n FROM multiclass_predictions GROUP BY ALL"),
     ("lab", "SELECT lbl, dense_rank() OVER (ORDER BY lbl) - 1 AS idx FROM (SELECT actual AS lbl FROM "
             "multiclass_predictions UNION SELECT predicted FROM multiclass_predictions) u")]))
def q_confusion_matrix(spark, sf):
    return M.confusion_cells(V.multiclass_predictions(spark, sf), "actual", "predicted")


@query("accuracy", Q.compose("SELECT round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM predictions",
                             ("predictions",)))
def q_accuracy(spark, sf):
    return M.accuracy(V.predictions(spark, sf), "label", "prediction").select(r6("accuracy").alias("accuracy"))


@query("macro_prf", Q.compose("SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 "
                              "FROM mprf", ("multiclass_predictions",),
                              Q.macro_prf_sql("multiclass_predictions", "actual", "predicted")))
def q_macro_prf(spark, sf):
    m = M.macro_prf(V.multiclass_predictions(spark, sf), "actual", "predicted")
    return m.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_prf_binary", Q.compose("SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 "
                                     "FROM mprf", ("predictions",), Q.macro_prf_sql("predictions", "label", "prediction")))
def q_macro_prf_binary(spark, sf):
    m = M.macro_prf(V.predictions(spark, sf), "label", "prediction")
    return m.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("roc_auc", Q.compose(
    "SELECT round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc FROM c",
    ("predictions",),
    [("d", "SELECT score AS s, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY score"),
     ("c", "SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d")]))
def q_roc_auc(spark, sf):
    return M.roc_auc(V.predictions(spark, sf), "label", "score").select(r6("roc_auc").alias("roc_auc"))


def _auc_sql(src: str, group: str) -> list[tuple[str, str]]:
    return [("d", f"SELECT {group}, score AS s, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY ALL"),
            ("c", f"SELECT *, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d"),
            ("a", f"SELECT {group}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) "
                  f"END AS roc_auc FROM c GROUP BY {group}")]


@query("roc_auc_by_group", Q.compose("SELECT l_suppkey, roc_auc FROM a", (), [
    ("p", "SELECT l_suppkey, CAST(l_quantity > 25 AS INTEGER) AS label, l_extendedprice AS score FROM lineitem"), *_auc_sql("p", "l_suppkey")]))
def q_roc_auc_by_group(spark, sf):
    """A20 for every supplier's lines in one plan, by a continuous score."""
    li = V.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") > 25).cast("int").alias("label"), F.col("l_extendedprice").alias("score"))
    return M.roc_auc(li, "label", "score", group=["l_suppkey"]).select("l_suppkey", r6("roc_auc").alias("roc_auc"))


@query("regression_metrics", Q.compose(
    """SELECT round(sqrt(avg((y - y_pred) * (y - y_pred))), 6) AS rmse, round(avg(abs(y - y_pred)), 6) AS mae,
       round(1 - sum((y - y_pred) * (y - y_pred)) / (count(y) * var_pop(y)), 6) AS r2 FROM predictions""", ("predictions",)))
def q_regression_metrics(spark, sf):
    m = M.regression_metrics(V.predictions(spark, sf), "y", "y_pred")
    return m.select(r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("r2").alias("r2"))


@query("residual_summary", Q.compose(
    "SELECT round(avg(y - y_pred), 6) AS residual_mean, round(stddev_pop(y - y_pred), 6) AS residual_std FROM predictions",
    ("predictions",)))
def q_residual_summary(spark, sf):
    m = M.regression_metrics(V.predictions(spark, sf), "y", "y_pred")
    return m.select(r6("residual_mean").alias("residual_mean"), r6("residual_std").alias("residual_std"))


_CV_SRC = ("cvs", "SELECT o_orderkey, CAST(o_orderstatus = 'P' AS INTEGER) AS is_p, "
                  "CAST(o_totalprice > 250000 AS INTEGER) AS pred FROM orders")


@query("cv_mean", Q.compose("SELECT round(avg(f1), 6) AS cv_score FROM mprf", (),
                            [_CV_SRC, ("fo", Q.folds_sql("cvs", "o_orderkey", "is_p"))]
                            + Q.macro_prf_sql("fo", "is_p", "pred", group="fold")))
def q_cv_mean(spark, sf):
    o = V.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "P").cast("int").alias("is_p"),
        (F.col("o_totalprice") > 250000).cast("int").alias("pred"))
    fo = SP.cv_folds(o, FLAG_SPEC, key="o_orderkey")
    return M.cv_mean(fo, "f1", "is_p", "pred").select(r6("cv_score").alias("cv_score"))


@query("cv_mean_auc", Q.compose("SELECT round(avg(roc_auc), 6) AS cv_score FROM a", (), [
    ("cvs", "SELECT o_orderkey, CAST(o_orderstatus = 'P' AS INTEGER) AS is_p, o_totalprice AS score FROM orders"),
    ("fo", Q.folds_sql("cvs", "o_orderkey", "is_p")), ("p", "SELECT fold, is_p AS label, score FROM fo"), *_auc_sql("p", "fold")]))
def q_cv_mean_auc(spark, sf):
    """A23 by exact AUC: every fold ranked in one plan."""
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").cast("int").alias("is_p"), F.col("o_totalprice").alias("score"))
    fo = SP.cv_folds(o, FLAG_SPEC, key="o_orderkey")
    return M.cv_mean(fo, "roc_auc", "is_p", "is_p", "score").select(r6("cv_score").alias("cv_score"))


@query("matrix_total", Q.compose(
    """SELECT count(*) AS total, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM predictions""", ("predictions",)))
def q_matrix_total(spark, sf):
    cells = M.confusion_cells(V.predictions(spark, sf), "label", "prediction")
    return M.matrix_total(cells)


# ====================================================================== model operators (rows-only)

def _flagship_folds(spark, sf):
    split, model, _ = flagship(spark, sf)
    model.passthrough = ("row_key", "is_test")
    X = model.transform(split.withColumn("row_key", F.col("o_orderkey")))
    tr = SP.cv_folds(X.where(~F.col("is_test")), FLAG_SPEC, key="row_key")
    return X, tr, model.plan.final_feature_names


@query("cv_score")
def q_cv_score(spark, sf):
    """M5: 3-fold CV macro F1 of one forest setting on the flagship features."""
    from tabml.operators import search as SE
    _, tr, feats = _flagship_folds(spark, sf)
    s = SE.cv_score(tr, FLAG_SPEC, feats, {"n_estimators": 50, "max_depth": 6, "min_samples_split": 4})
    return spark.createDataFrame([(float(s),)], "cv_score double")


@query("param_search")
def q_param_search(spark, sf):
    """M6 + W5 + A24: a seeded search with the spec's own trial budget; one row per trial, best and convergence flags."""
    from tabml.operators import search as SE
    _, tr, feats = _flagship_folds(spark, sf)
    res = SE.tune_hyperparameters(tr, FLAG_SPEC, feats)
    best = max(res.search_history, key=lambda t: (t.score, -t.trial_number)).trial_number
    rows = [(t.trial_number, t.params["n_estimators"], t.params["max_depth"], t.params["min_samples_split"],
             t.score, t.trial_number == best, res.converged) for t in res.search_history]
    return spark.createDataFrame(rows, "trial_number int, n_estimators int, max_depth int, min_samples_split int, "
                                       "score double, is_best boolean, converged boolean")


@query("train_and_evaluate")
def q_train_and_evaluate(spark, sf):
    """M3 + M4 + M7: fit on train rows, predict test rows (label and P(class 1))."""
    from tabml.operators import train as T
    from tabml.reports import TuningResult
    X, _, feats = _flagship_folds(spark, sf)
    tu = TuningResult(best_params=dict(T.DEFAULT_PARAMS), best_cv_score=0.0, metric_optimized="f1_macro", converged=True)
    _, report, preds = T.train_and_evaluate(X, FLAG_SPEC, tu, feats)
    return preds.select(F.col("row_key").alias("o_orderkey"), "is_p", "pred", "score")


# ====================================================================== run analytics

from tabml.operators import runs as RU  # noqa: E402
from tabml.operators import search as SE  # noqa: E402
from tabml.sources import runviews as RV  # noqa: E402

_H = ("h", RV.duck_form(RV.HISTORY_SQL))
_TR = ("tr", RV.duck_form(RV.TRACE_SQL))
_TL = ("tl", RV.duck_form(RV.TRIALS_SQL))
_RN = ("rn", RV.duck_form(RV.RUNS_SQL))
_LAST = "row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) = 1"
_ETYPE = """CASE WHEN contains(lower(event), 'fail ->') THEN 'loop_back' WHEN contains(lower(event), 'escalat') THEN 'error'
  WHEN contains(lower(event), 'proceed=false') OR contains(lower(event), 'concerns') THEN 'warning'
  WHEN contains(lower(event), 'proceed=true') OR contains(lower(event), 'complete') OR contains(lower(event), 'passed')
  THEN 'success' ELSE 'info' END"""


@query("event_type", Q.compose(f"SELECT run_id, seq, {_ETYPE} AS type FROM h", ctes=[_H]))
def q_event_type(spark, sf):
    return RV.history(spark, sf).select("run_id", "seq", RU.event_type(F.col("event")).alias("type"))


@query("latest_proceed", Q.compose(
    """SELECT r.run_id, l.proceed FROM (SELECT DISTINCT run_id FROM h) r LEFT JOIN
       (SELECT run_id, contains(event, 'proceed=True') AS proceed FROM h
        WHERE stage = 'data_agent' AND (contains(event, 'proceed=True') OR contains(event, 'proceed=False'))
        QUALIFY """ + _LAST + ") l USING (run_id)", ctes=[_H]))
def q_latest_proceed(spark, sf):
    return RU.latest_proceed(RV.history(spark, sf), "data_agent")


@query("resume_point", Q.compose(
    """SELECT s.run_id, CASE WHEN s.skipped THEN 'tuning' WHEN l.step = 'revisit_features' THEN 'feature'
       WHEN l.step = 'expand_hyperparam_search' THEN 'tuning' END AS resume_from
       FROM (SELECT run_id, bool_or(contains(event, 'skipping feature_agent')) AS skipped FROM h GROUP BY run_id) s
       LEFT JOIN (SELECT run_id, regexp_extract(event, 'fail -> recommended_next_step=(\\w+)', 1) AS step FROM h
                  WHERE regexp_extract(event, 'fail -> recommended_next_step=(\\w+)', 1) <> '' QUALIFY """ + _LAST
    + ") l USING (run_id)", ctes=[_H]))
def q_resume_point(spark, sf):
    return RU.resume_point(RV.history(spark, sf))


@query("escalation_reason", Q.compose(
    """SELECT r.run_id, l.event AS reason FROM (SELECT DISTINCT run_id FROM h) r LEFT JOIN
       (SELECT run_id, event FROM h WHERE contains(lower(event), 'escalat') QUALIFY """ + _LAST + ") l USING (run_id)",
    ctes=[_H]))
def q_escalation_reason(spark, sf):
    return RU.escalation_reason(RV.history(spark, sf))


_COST = ("c", """SELECT *, CAST(dcost AS DOUBLE) AS estimated_cost_usd FROM (SELECT tr.*,
                 round(prompt_tokens * coalesce(p.pr, 0) + completion_tokens * coalesce(p.cr, 0), 6) AS dcost
                 FROM tr LEFT JOIN (SELECT 'gpt-4o-mini' AS model, CAST(0.00000015 AS DECIMAL(18,12)) AS pr,
                 CAST(0.0000006 AS DECIMAL(18,12)) AS cr) p USING (model)) x""")


@query("price_lookup", Q.compose("SELECT run_id, seq, model, estimated_cost_usd FROM c", ctes=[_TR, _COST]))
def q_price_lookup(spark, sf):
    return RU.with_cost(RV.trace(spark, sf)).select("run_id", "seq", "model", "estimated_cost_usd")


@query("trace_totals", Q.compose("SELECT run_id, CAST(round(sum(dcost), 6) AS DOUBLE) AS total_cost_usd, "
                                 "CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM c GROUP BY run_id",
                                 ctes=[_TR, _COST]))
def q_trace_totals(spark, sf):
    return RU.trace_totals(RV.trace(spark, sf))


_CONV = ("cv", """SELECT a.run_id, a.n_trials, a.best_score,
     coalesce(e.early_best >= a.best_score - 1e-9, false) AS converged
   FROM (SELECT run_id, count(*) AS n_trials, max(score) AS best_score FROM tl GROUP BY run_id) a
   LEFT JOIN (SELECT t.run_id, max(t.score) AS early_best FROM tl t JOIN
              (SELECT run_id, count(*) AS n FROM tl GROUP BY run_id) c USING (run_id)
              WHERE t.trial_number < c.n - greatest(1, c.n // 5) GROUP BY t.run_id) e USING (run_id)""")


@query("convergence", Q.compose("SELECT run_id, n_trials, best_score, converged FROM cv", ctes=[_TL, _CONV]))
def q_convergence(spark, sf):
    return SE.convergence_table(RV.trials(spark, sf))


@query("best_trial", Q.compose(
    "SELECT run_id, trial_number AS best_trial, score AS best_score FROM tl "
    "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, trial_number) = 1", ctes=[_TL]))
def q_best_trial(spark, sf):
    return SE.best_trial_table(RV.trials(spark, sf))


_HIB = "(" + ", ".join(f"'{m}'" for m in ("accuracy", "f1", "precision", "recall", "roc_auc", "r2")) + ")"


@query("verdict", Q.compose(
    f"""SELECT run_id, success_metric, CASE WHEN success_metric IN {_HIB} THEN metric_value >= metric_threshold
        ELSE metric_value <= metric_threshold END AS passed FROM rn""", ctes=[_RN]))
def q_verdict(spark, sf):
    r = RV.runs(spark, sf)
    return r.select("run_id", "success_metric",
                    RU.verdict(F.col("success_metric"), F.col("metric_value"), F.col("metric_threshold")).alias("passed"))


@query("failure_step", Q.compose(
    f"""SELECT rn.run_id, CASE
          WHEN (CASE WHEN success_metric IN {_HIB} THEN metric_value >= metric_threshold ELSE metric_value <= metric_threshold END)
          THEN NULL
          WHEN coalesce(cv.converged, false) AND (CASE WHEN success_metric IN {_HIB} THEN metric_threshold - metric_value
               ELSE metric_value - metric_threshold END) > 0.1 * abs(CASE WHEN metric_threshold = 0 THEN 1 ELSE metric_threshold END)
          THEN 'revisit_features'
          WHEN NOT coalesce(cv.converged, false) THEN 'expand_hyperparam_search' ELSE 'insufficient_data' END AS next_step
        FROM rn LEFT JOIN cv USING (run_id)""", ctes=[_RN, _TL, _CONV]))
def q_failure_step(spark, sf):
    r = RV.runs(spark, sf).join(SE.convergence_table(RV.trials(spark, sf)).select("run_id", "converged"), "run_id", "left")
    return r.select("run_id", RU.failure_step(F.col("success_metric"), F.col("metric_value"), F.col("metric_threshold"),
                                              F.col("converged")).alias("next_step"))


_RUNS_EXT = ("rx", f"""SELECT *, CASE WHEN (CASE WHEN success_metric IN {_HIB} THEN metric_value >= metric_threshold
     ELSE metric_value <= metric_threshold END) THEN 'pass' ELSE 'fail' END AS pass_fail,
     metric_value IS NOT NULL AS has_evaluation, max_tuning_trials IS NOT NULL AS has_tuning, true AS has_eda FROM rn""")


def _runs_ext(spark, sf):
    r = RV.runs(spark, sf)
    return r.withColumn("pass_fail", F.when(RU.verdict(F.col("success_metric"), F.col("metric_value"),
                                                       F.col("metric_threshold")), "pass").otherwise("fail")) \
        .withColumn("has_evaluation", F.col("metric_value").isNotNull()) \
        .withColumn("has_tuning", F.col("max_tuning_trials").isNotNull()).withColumn("has_eda", F.lit(True))


@query("run_status", Q.compose(
    """SELECT run_id, CASE WHEN status = 'done' THEN 'completed' WHEN status = 'escalated' THEN 'failed'
       WHEN status = 'evaluated' AND pass_fail = 'fail' THEN 'looping_back' ELSE 'running' END AS run_status,
       CASE WHEN status = 'done' THEN 'completed' WHEN status = 'created' THEN 'data' WHEN status = 'data_ready' THEN 'feature'
       WHEN status = 'features_ready' THEN 'tuning' WHEN status IN ('tuned', 'evaluated') THEN 'training'
       WHEN status = 'escalated' THEN CASE WHEN has_evaluation THEN 'training' WHEN has_tuning THEN 'tuning'
       WHEN has_eda THEN 'feature' ELSE 'data' END END AS run_stage FROM rx""", ctes=[_RN, _RUNS_EXT]))
def q_run_status(spark, sf):
    r = _runs_ext(spark, sf)
    return r.select("run_id", RU.run_status(r).alias("run_status"), RU.run_stage(r).alias("run_stage"))


_PARAM_TEXT = ("pt", """SELECT p_partkey, 'size' AS src, CAST(p_size AS STRING) AS txt FROM part UNION ALL
   SELECT p_partkey, 'price', CAST(p_retailprice AS STRING) FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part""")


_ODD = {"suffix": "{}d", "exponent": "{}e3", "word": "nan", "long": "{}12345678901234567890"}


@query("parse_param", Q.compose(
    """SELECT p_partkey, src, CASE WHEN f THEN 'float' WHEN i THEN 'int' ELSE 'str' END AS value_type,
       CASE WHEN i THEN TRY_CAST(trim(txt) AS BIGINT) END AS int_value, CASE WHEN f THEN TRY_CAST(trim(txt) AS DOUBLE) END AS float_value,
       CASE WHEN NOT f AND (NOT i OR TRY_CAST(trim(txt) AS BIGINT) IS NULL) THEN txt END AS text_value FROM
       (SELECT *, regexp_matches(txt, '[.eE]') AND regexp_matches(txt, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') AS f,
               regexp_matches(txt, '^\\s*[+-]?[0-9]+\\s*$') AS i FROM (SELECT * FROM pt
        UNION ALL SELECT p_partkey, 'suffix', p_size || 'd' FROM part UNION ALL SELECT p_partkey, 'exponent', p_size || 'e3' FROM part
        UNION ALL SELECT p_partkey, 'word', 'nan' FROM part UNION ALL SELECT p_partkey, 'long', p_size || '12345678901234567890' FROM part)) t""",
    ctes=[_PARAM_TEXT]))
def q_parse_param(spark, sf):
    p = V.table(spark, sf, "part")
    pt = (p.select("p_partkey", F.lit("size").alias("src"), F.col("p_size").cast("string").alias("txt"))
          .unionByName(p.select("p_partkey", F.lit("price").alias("src"), F.col("p_retailprice").cast("string").alias("txt")))
          .unionByName(p.select("p_partkey", F.lit("brand").alias("src"), F.col("p_brand").alias("txt"))))
    for src, form in _ODD.items():
        before, _, after = form.partition("{}")
        odd = F.concat(F.col("p_size").cast("string"), F.lit(after)) if "{}" in form else F.lit(before)
        pt = pt.unionByName(p.select("p_partkey", F.lit(src).alias("src"), odd.alias("txt")))
    return pt.select("p_partkey", "src", *RU.parse_param(F.col("txt")))


@query("top8_corr", Q.compose(
    """SELECT run_id, feature, corr, CAST(row_number() OVER (PARTITION BY run_id ORDER BY corr DESC, feature) AS INTEGER)
       AS rank_in_group FROM (SELECT run_id, 'trial_' || CAST(trial_number AS STRING) AS feature, score AS corr FROM tl) t
       QUALIFY rank_in_group <= 8""", ctes=[_TL]))
def q_top8_corr(spark, sf):
    t = RV.trials(spark, sf).select("run_id", F.concat(F.lit("trial_"), F.col("trial_number").cast("string")).alias("feature"),
                                    F.col("score").alias("corr"))
    return RU.top_k_per_group(t, "run_id", [F.col("corr").desc(), F.col("feature")], RU.TOP_CORRELATIONS) \
        .withColumn("rank_in_group", F.col("rank_in_group").cast("int"))


@query("corr_sorted", Q.compose("SELECT run_id, trial_number, score FROM tl ORDER BY run_id, score DESC", ctes=[_TL]))
def q_corr_sorted(spark, sf):
    return RV.trials(spark, sf).select("run_id", "trial_number", "score").orderBy("run_id", F.col("score").desc())


@query("newest_runs", Q.compose("SELECT run_id, updated_at FROM rn ORDER BY updated_at DESC, run_id LIMIT 30", ctes=[_RN]))
def q_newest_runs(spark, sf):
    return RU.newest_runs(RV.runs(spark, sf)).select("run_id", "updated_at")


@query("timeline", Q.compose(f"SELECT run_id, ts, seq, stage, event, {_ETYPE} AS type FROM h ORDER BY run_id, ts, seq",
                             ctes=[_H]))
def q_timeline(spark, sf):
    return RU.timeline(RV.history(spark, sf)).select("run_id", "ts", "seq", "stage", "event", "type")


_KINDS = ("loop_back", "error", "warning", "success", "info")


@query("report_counts", Q.compose(
    "SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS {k}" for k in _KINDS)
    + f" FROM (SELECT run_id, {_ETYPE} AS type FROM h) t GROUP BY run_id", ctes=[_H]))
def q_report_counts(spark, sf):
    h = RV.history(spark, sf).select("run_id", RU.event_type(F.col("event")).alias("kind"))
    return RU.report_counts(h, _KINDS)


@query("decision_union", Q.compose(
    """SELECT feature, CASE WHEN kind IN ('datetime_part', 'onehot', 'interaction') AND decision <> 'dropped_low_signal'
       AND decision <> 'dropped_low_variance' THEN 'engineered' ELSE 'dropped' END AS kind FROM fd
       WHERE (kind IN ('datetime_part', 'onehot', 'interaction') AND decision NOT IN ('dropped_low_signal', 'dropped_low_variance'))
          OR decision IN ('dropped_low_signal', 'dropped_low_variance', 'decomposed', 'dropped_high_cardinality')""",
    ("flagged",), [("fd", Q.decisions_sql("flagged", "o_totalprice", _FLAGGED_NUM, _FLAGGED_COLS))]))
def q_decision_union(spark, sf):
    _, _, d = FE.fit_plan(V.flagged(spark, sf), _spec("regression", "o_totalprice"))
    t = FE.decisions_frame(spark, d)
    dropped_d = ("dropped_low_signal", "dropped_low_variance", "decomposed", "dropped_high_cardinality")
    eng = t.where(F.col("kind").isin("datetime_part", "onehot", "interaction") & ~F.col("decision").isin(*dropped_d))
    drp = t.where(F.col("decision").isin(*dropped_d))
    return RU.decision_union(eng.select("feature"), drp.select("feature"))


# candidate problem specs, one per user of ``events`` (spec checks run over all of them)
REQUESTS_SQL = """SELECT concat('req-', CAST(user_id AS STRING)) AS request_id,
  CASE user_id % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'part' WHEN 2 THEN 'customer' END AS dataset,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'classification' ELSE 'regression' END AS task_type,
  CASE user_id % 6 WHEN 0 THEN 'o_orderstatus' WHEN 1 THEN 'p_retailprice' WHEN 2 THEN 'c_mktsegment'
       WHEN 3 THEN 'label' WHEN 4 THEN NULL ELSE 'o_totalprice' END AS target_column,
  CASE user_id % 7 WHEN 0 THEN 'f1' WHEN 1 THEN 'rmse' WHEN 2 THEN 'accuracy' WHEN 3 THEN 'r2' WHEN 4 THEN 'roc_auc'
       WHEN 5 THEN 'mae' END AS success_metric,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(0.8 AS DOUBLE) END AS metric_threshold,
  CASE user_id % 3 WHEN 0 THEN 'builtin:orders_status' WHEN 1 THEN 'data/x.csv' ELSE 'somewhere.txt' END AS data_source,
  CASE WHEN user_id % 13 = 0 THEN 'metric_threshold' END AS unclear
FROM (SELECT DISTINCT user_id FROM {events}) u"""

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
           "pages", "benchmark", "labels", "conversations"]
_INFO = ("ic", "SELECT table_name AS dataset, column_name, CAST(ordinal_position - 1 AS INTEGER) AS position "
               "FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _TABLES) + ")")


def _columns_table(spark, sf):
    rows = []
    for t in _TABLES:
        for i, f in enumerate(V.table(spark, sf, t).schema.fields):
            rows.append((t, f.name, i))
    return spark.createDataFrame(rows, "dataset string, column_name string, position int")


@query("guess_target", Q.compose(
    "SELECT dataset, coalesce(min_by(column_name, CASE WHEN lower(column_name) IN ("
    + ", ".join(f"'{h}'" for h in RU.TARGET_NAME_HINTS) + ") THEN position END), max_by(column_name, position)) "
    "AS target_guess FROM ic GROUP BY dataset", ctes=[_INFO]))
def q_guess_target(spark, sf):
    return RU.guess_target(_columns_table(spark, sf))


@query("unknown_target", Q.compose(
    """SELECT r.request_id, r.dataset, r.target_column, (SELECT string_agg(column_name, ',' ORDER BY column_name)
       FROM ic c WHERE c.dataset = r.dataset) AS real_columns
       FROM rq r WHERE r.dataset IS NOT NULL AND r.target_column IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM ic c WHERE c.dataset = r.dataset AND c.column_name = r.target_column)""",
    ctes=[_INFO, ("rq", REQUESTS_SQL.replace("{events}", "events"))]))
def q_unknown_target(spark, sf):
    """J5 over every candidate spec (one per user in ``events``): targets that are not real columns,
    with the dataset's real columns, sorted."""
    req = spark.sql(REQUESTS_SQL, events=V.table(spark, sf, "events"))
    req = req.where(F.col("dataset").isNotNull() & F.col("target_column").isNotNull())
    out = RU.unknown_target(req.select("request_id", "dataset", "target_column"), _columns_table(spark, sf))
    return out.select("request_id", "dataset", "target_column", F.array_join("real_columns", ",").alias("real_columns"))


@query("metric_delta", Q.compose(
    "SELECT run_id, round(max(score) - 0.45, 6) AS delta, round(least(min(score), 0.45) * 0.96, 6) AS lower_bound, "
    "round(greatest(max(score), 0.45) * 1.03, 6) AS upper_bound FROM tl GROUP BY run_id", ctes=[_TL]))
def q_metric_delta(spark, sf):
    t = RV.trials(spark, sf).withColumn("threshold", F.lit(0.45))
    m = RU.metric_delta(t)
    return m.select("run_id", *[r6(c).alias(c) for c in ("delta", "lower_bound", "upper_bound")])


@query("run_search", Q.compose(
    "SELECT run_id, data_source FROM rn WHERE task_type = 'classification' AND "
    "(contains(lower(run_id), '1') OR contains(lower(data_source), '1'))", ctes=[_RN]))
def q_run_search(spark, sf):
    return RU.run_search(RV.runs(spark, sf), "1", "classification").select("run_id", "data_source")


@query("replace_rows", Q.compose(
    """SELECT * FROM tl WHERE run_id NOT IN ('run-1', 'run-2') UNION ALL
       SELECT run_id, trial_number, score + 1 AS score, n_estimators, max_depth, min_samples_split FROM tl
       WHERE run_id IN ('run-1', 'run-2') AND trial_number < 3""", ctes=[_TL]))
def q_replace_rows(spark, sf):
    t = RV.trials(spark, sf)
    new = t.where(F.col("run_id").isin("run-1", "run-2") & (F.col("trial_number") < 3)).withColumn("score", F.col("score") + 1)
    return RU.replace_rows(t, new)


@query("spec_override", Q.compose(
    """SELECT run_id, coalesce(o.max_tuning_trials, d.max_tuning_trials) AS max_tuning_trials,
       coalesce(o.metric_threshold, d.metric_threshold) AS metric_threshold FROM rn d LEFT JOIN
       (SELECT run_id, CASE WHEN loop_count % 2 = 0 THEN 100 END AS max_tuning_trials, CAST(NULL AS DOUBLE) AS metric_threshold
        FROM rn) o USING (run_id)""", ctes=[_RN]))
def q_spec_override(spark, sf):
    r = RV.runs(spark, sf)
    o = r.select("run_id", F.when(F.col("loop_count") % 2 == 0, 100).alias("max_tuning_trials"),
                 F.lit(None).cast("double").alias("metric_threshold"))
    return RU.spec_override(r, o, ["max_tuning_trials", "metric_threshold"])


@query("matrix_rebuild", Q.compose(
    "SELECT row_idx, string_agg(CAST(count AS STRING), ',' ORDER BY col_idx) AS counts FROM cells GROUP BY row_idx",
    ("multiclass_predictions",),
    [("cnt", "SELECT actual, predicted, count(*) AS n FROM multiclass_predictions GROUP BY ALL"),
     ("lab", "SELECT lbl, dense_rank() OVER (ORDER BY lbl) - 1 AS idx FROM (SELECT actual AS lbl FROM "
             "multiclass_predictions UNION SELECT predicted FROM multiclass_predictions) u"),
     ("cells", "SELECT CAST(l1.idx AS INTEGER) AS row_idx, CAST(l2.idx AS INTEGER) AS col_idx, coalesce(c.n, 0) AS count "
               "FROM lab l1 CROSS JOIN lab l2 LEFT JOIN cnt c ON c.actual = l1.lbl AND c.predicted = l2.lbl")]))
def q_matrix_rebuild(spark, sf):
    """cells back to rows of a matrix (ordered by column index)."""
    cells = M.confusion_cells(V.multiclass_predictions(spark, sf), "actual", "predicted")
    return cells.groupBy("row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("col_idx", "count"))), lambda s: s["count"].cast("string")), ",").alias("counts"))


_J_SQL = """SELECT rn.run_id, rn.status, h.n_events, h.last_event, tt.total_tokens, tt.total_cost_usd, cv.n_trials, cv.best_score
  FROM rn LEFT JOIN (SELECT run_id, count(*) AS n_events, arg_max(event, ts) AS last_event FROM h GROUP BY run_id) h USING (run_id)
  LEFT JOIN (SELECT run_id, CAST(round(sum(dcost), 6) AS DOUBLE) AS total_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
             FROM c GROUP BY run_id) tt USING (run_id)
  LEFT JOIN cv USING (run_id)"""


@query("run_document", Q.compose(_J_SQL, ctes=[_RN, _H, _TR, _COST, _TL, _CONV]))
def q_run_document(spark, sf):
    """Every child table aggregated per run first, then left joins on run_id."""
    h = RV.history(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"),
                                                     F.max_by("event", F.col("ts")).alias("last_event"))
    tt = RU.trace_totals(RV.trace(spark, sf))
    cv = SE.convergence_table(RV.trials(spark, sf)).select("run_id", "n_trials", "best_score")
    return (RV.runs(spark, sf).select("run_id", "status").join(h, "run_id", "left").join(tt, "run_id", "left")
            .join(cv, "run_id", "left"))


@query("run_summary_join", Q.compose(
    """SELECT r.run_id, r.created_at, r.status, r.task_type, r.success_metric, e.metric_value, e.pass_fail
       FROM rn r LEFT JOIN (SELECT run_id, metric_value, pass_fail FROM rx WHERE status <> 'escalated') e USING (run_id)""",
    ctes=[_RN, _RUNS_EXT]))
def q_run_summary_join(spark, sf):
    """Runs left-joined with their spec and (where present) evaluation."""
    r = RV.runs(spark, sf)
    runs = r.select("run_id", "created_at", "status")
    spec = r.select("run_id", "task_type", "success_metric")
    ev = _runs_ext(spark, sf).where(F.col("status") != "escalated").select("run_id", "metric_value", "pass_fail")
    return runs.join(spec, "run_id", "left").join(ev, "run_id", "left")


# ====================================================================== run store

from tabml.sources import documents as DOC  # noqa: E402
from tabml.sources import runstore as RS  # noqa: E402


def _by_run(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left joins of ``base`` (one row a run) with parts (one row a run) on run_id, as one grouping: a chain of joins would hold two sort
    buffers for every part in each task."""
    every = base.withColumn("__here", F.lit(True))
    for p in parts:
        every = every.unionByName(p.where("run_id is not null"), allowMissingColumns=True)
    return every.groupBy("run_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c != "run_id"]).where("__here").drop("__here")


def _store_frames(spark, sf):
    """The derived runs in the store schemas; trials go to their own flat table (never an array per run)."""
    r = _runs_ext(spark, sf)
    tl = RV.trials(spark, sf)
    conv = SE.convergence_table(tl)
    best = SE.best_trial_table(tl)
    params = F.create_map(F.lit("n_estimators"), F.col("n_estimators").cast("string"), F.lit("max_depth"),
                          F.col("max_depth").cast("string"), F.lit("min_samples_split"),
                          F.col("min_samples_split").cast("string"))
    trials = tl.select("run_id", "trial_number", params.alias("params"), "score")
    hist = tl.groupBy("run_id").agg(
        F.max_by(params, F.struct(F.col("score"), -F.col("trial_number"))).alias("best_params"))
    tuning = F.when(F.col("n_trials").isNotNull(), F.struct(
        F.col("best_params"), F.col("best_score").alias("best_cv_score"), F.lit("f1_macro").alias("metric_optimized"),
        F.col("converged"), F.col("n_trials").cast("int"), F.col("n_trials").cast("int"),
        F.lit("").alias("convergence_notes")))
    matrix = spark.sql(RV.MATRIX_SQL, events=V.table(spark, sf, "events"))
    matrix = matrix.select("run_id", F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"))
    residual = spark.sql(RV.RESIDUAL_SQL, events=V.table(spark, sf, "events"))
    residual = residual.select("run_id", F.create_map(F.lit("mean"), "mean", F.lit("top"), "top").alias("residual"))
    failure = F.when(F.col("pass_fail") == "fail", F.struct(F.lit("threshold missed").alias("summary"), F.when(
        F.col("loop_count") % 2 == 0, "revisit_features").otherwise("expand_hyperparam_search").alias("recommended_next_step")))
    evaluation = F.when(F.col("metric_value").isNotNull(), F.struct(
        F.create_map(F.col("success_metric"), F.col("metric_value")).alias("test_metrics"), F.col("success_metric"),
        F.col("metric_value"), F.col("metric_threshold"), F.col("pass_fail"), F.col("matrix"), F.col("residual"), failure,
        F.when(F.col("pass_fail") == "pass", F.concat(F.lit("models/"), F.col("run_id")))))

    types = RV.types(spark, sf).checkpoint()   # read by every section

    def parts(head: str, *lists: str) -> DataFrame:
        found = []
        for name in lists:
            rows = RV.section(types, name)
            entry = F.struct("ord", F.col("v").alias("x") if "v" in rows.columns else
                             F.struct(*[c for c in rows.columns if c not in ("run_id", "ord")]).alias("x"))
            found.append(rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]).alias(name)))
        return _by_run(RV.section(types, head), *found)

    pf = parts("profile", "column_schema", "class_balance", "outlier_flags", "cleaning_actions_taken", "warnings")
    some = lambda c: F.coalesce(c, F.array())
    pf = pf.select("run_id", F.struct("row_count", "column_count", "column_schema", "class_balance", some("outlier_flags"),
                                      some("cleaning_actions_taken"), some("warnings"), "blocking_issue").cast(RS.PROFILE_T).alias("data_profile"))
    ed = parts("eda", "correlation_summary", "engineered_features", "dropped_features", "leakage_warnings", "data_quality_warnings", "final_feature_names")
    ed = ed.select("run_id", F.struct("correlation_summary", some("engineered_features"), some("dropped_features"), some("leakage_warnings"),
                                      some("data_quality_warnings"), "notes", some("final_feature_names")).cast(RS.EDA_T).alias("eda_report"))
    spec = F.struct("task_type", F.lit("target").alias("target_column"), "success_metric", "metric_threshold",
                    "data_source", F.lit(None).cast("int"), "max_tuning_trials", F.lit(False), "max_loop_backs",
                    F.lit(None).cast("string"))
    runs = (_by_run(r, conv, best.select("run_id"), hist, matrix, residual, pf, ed)
            .select("run_id", "status", "loop_count", F.col("created_at").cast("timestamp"),
                    F.col("updated_at").cast("timestamp"), spec.cast(RS.SPEC_T).alias("spec"), "data_profile", "eda_report",
                    tuning.cast(RS.TUNING_T).alias("tuning_result"), evaluation.cast(RS.EVAL_T).alias("evaluation_report")))
    h = RV.history(spark, sf).select("run_id", "seq", F.col("ts").cast("timestamp"), "stage", "event")
    t = RV.trace(spark, sf)
    tr = RU.with_cost(t).select("run_id", "seq", F.col("ts").cast("timestamp"), "agent", "model", "prompt_tokens",
                                "completion_tokens", "total_tokens", F.lit(0.0).alias("latency_ms"), "estimated_cost_usd")
    return runs, h, tr, trials


def _fresh_store(spark, sf) -> str:
    root = scratch_path(spark, "runstore")
    runs, h, tr, trials = _store_frames(spark, sf)
    RS.write_runs_frame(root, runs, h, tr, trials)
    return root


_STORES: dict[tuple[str, str], str] = {}


def _store(spark, sf) -> str:
    """The derived runs in a store that is written once per application and only read by the queries that share it."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORES:
        _STORES[at] = _fresh_store(spark, sf)
    return _STORES[at]


@query("run_store_read", Q.compose("SELECT run_id, seq, stage, event FROM h", ctes=[_H]))
def q_run_store_read(spark, sf):
    """S6 + S7: the derived runs written to a fresh store, history read back through its view."""
    root = _fresh_store(spark, sf)
    return DOC.run_tables(spark, root)["history_entries"].select("run_id", "seq", "stage", "event")


@query("run_store_trials", Q.compose("SELECT run_id, trial_number, score FROM tl", ctes=[_TL]))
def q_run_store_trials(spark, sf):
    root = _fresh_store(spark, sf)
    return DOC.run_tables(spark, root)["trial_records"].select("run_id", "trial_number", "score")


@query("run_list", Q.compose(
    "SELECT run_id, status, task_type, data_source, metric_value, pass_fail FROM rx ORDER BY created_at DESC",
    ctes=[_RN, _RUNS_EXT]))
def q_run_list(spark, sf):
    root = _fresh_store(spark, sf)
    return RS.run_list(spark, root).select("run_id", "status", "task_type", "data_source", "metric_value", "pass_fail")


_REPLACED = "('run-0', 'run-1', 'run-2', 'run-3', 'run-4')"


@query("run_store_write", Q.compose(
    f"""SELECT run_id, seq, stage, event FROM h WHERE run_id NOT IN {_REPLACED} UNION ALL
        SELECT run_id, seq, stage, event FROM h WHERE run_id IN {_REPLACED}
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1""", ctes=[_H]))
def q_run_store_write(spark, sf):
    """S6 replace: runs 0-4 are written again with a one-event history; their old events are gone and
    every other run is untouched (dynamic partition overwrite)."""
    root = _fresh_store(spark, sf)
    h = DOC.run_tables(spark, root)["history_entries"]
    ids = ["run-0", "run-1", "run-2", "run-3", "run-4"]
    first = (h.where(F.col("run_id").isin(*ids)).groupBy("run_id")
             .agg(F.min_by(F.struct("seq", "ts", "stage", "event"), F.col("seq")).alias("f"))
             .select("run_id", "f.seq", "f.ts", "f.stage", "f.event"))
    staged = scratch_path(spark, "replace")
    first.write.parquet(staged)            # never overwrite a path while reading it
    RS.write_history(root, spark.read.parquet(staged).select("run_id", "seq", "ts", "stage", "event"))
    return DOC.run_tables(spark, root)["history_entries"].select("run_id", "seq", "stage", "event")


# Relational tables and whole documents of the store: the SQL forms read the derived inputs, never the store.
_SEC = [RV.TYPES_CTE, *[(f"s_{k}", v) for k, v in RV.SECTION_SQL.items()], _RN, _RUNS_EXT, _H, _TR, _COST, _TL, _CONV,
        ("mx", RV.duck_form(RV.MATRIX_SQL)), ("rs", RV.duck_form(RV.RESIDUAL_SQL)),
        ("bt", "SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, trial_number) = 1"),
        ("ev", """SELECT *, CASE WHEN pass_fail = 'pass' THEN 'models/' || run_id END AS model_artifact_path,
           CASE WHEN loop_count % 2 = 0 THEN 'revisit_features' ELSE 'expand_hyperparam_search' END AS step FROM rx WHERE metric_value IS NOT NULL""")]


def _params_sql(src: str, cols: str = "run_id") -> str:
    return " UNION ALL ".join(f"SELECT {cols}, '{p}' AS param_name, CAST({p} AS VARCHAR) AS param_value FROM {src}"
                              for p in ("n_estimators", "max_depth", "min_samples_split"))


def _by_key(sql: str, key: str) -> str:
    """ord of map entries: their rank by key."""
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {key}) - 1 AS INTEGER) AS ord FROM ({sql}) e"


TABLE_SQL = {
    "runs": "SELECT run_id, status, loop_count, created_at, updated_at FROM rn",
    "problem_specs": "SELECT run_id, task_type, 'target' AS target_column, success_metric, metric_threshold, data_source, "
                     "CAST(NULL AS VARCHAR) AS notes FROM rn",
    "pipeline_constraints": "SELECT run_id, CAST(NULL AS INTEGER) AS max_training_seconds, max_tuning_trials, false AS interpretability_required, "
                            "max_loop_backs FROM rn",
    "history_entries": "SELECT run_id, seq, ts, stage, event FROM h",
    "trace_entries": "SELECT run_id, seq, ts, agent, model, prompt_tokens, completion_tokens, total_tokens, CAST(0 AS DOUBLE) AS latency_ms, "
                     "estimated_cost_usd FROM c",
    "trial_records": "SELECT run_id, trial_number, score FROM tl",
    "trial_record_params": _params_sql("tl", "run_id, trial_number"),
    "data_profiles": "SELECT run_id, row_count, column_count, blocking_issue FROM s_profile",
    "eda_reports": "SELECT run_id, notes AS target_distribution_notes FROM s_eda",
    "tuning_results": "SELECT run_id, best_score AS best_cv_score, 'f1_macro' AS metric_optimized, CAST(n_trials AS INTEGER) AS search_budget_used, "
                      "CAST(n_trials AS INTEGER) AS search_budget_total, '' AS convergence_notes, converged FROM cv WHERE run_id IN (SELECT run_id FROM rn)",
    "evaluation_reports": "SELECT run_id, success_metric AS metric_optimized, metric_value, metric_threshold, pass_fail, model_artifact_path FROM ev",
    "failure_analyses": "SELECT run_id, 'threshold missed' AS summary, step AS recommended_next_step FROM ev WHERE pass_fail = 'fail'",
    "column_schemas": "SELECT run_id, ord, name, dtype, missing_pct, is_target FROM s_column_schema",
    "cleaning_actions": 'SELECT run_id, ord, col AS "column", action, rationale FROM s_cleaning_actions_taken',
    "class_balance_entries": "SELECT run_id, ord, label AS class_label, share AS proportion FROM s_class_balance",
    "data_profile_warnings": "SELECT run_id, ord, v AS warning_text FROM s_warnings",
    "outlier_flags": "SELECT run_id, ord, v AS column_name FROM s_outlier_flags",
    "feature_correlations": "SELECT run_id, ord, feature AS feature_name, corr AS correlation FROM s_correlation_summary",
    "feature_decisions": "SELECT run_id, ord, name, rationale, 'engineered' AS kind FROM s_engineered_features UNION ALL "
                         "SELECT run_id, ord, name, rationale, 'dropped' AS kind FROM s_dropped_features",
    "leakage_warnings": "SELECT run_id, ord, v AS warning_text FROM s_leakage_warnings",
    "data_quality_warnings": "SELECT run_id, ord, v AS warning_text FROM s_data_quality_warnings",
    "final_feature_names": "SELECT run_id, ord, v AS feature_name FROM s_final_feature_names",
    "tuning_best_params": _by_key(_params_sql("bt") .replace("FROM bt", "FROM bt WHERE run_id IN (SELECT run_id FROM rn)"), "param_name"),
    "test_metric_entries": "SELECT run_id, 0 AS ord, success_metric AS metric_name, metric_value AS value FROM ev",
    "residual_summary_entries": _by_key("SELECT run_id, 'mean' AS key, mean AS value FROM rs UNION ALL SELECT run_id, 'top', top FROM rs", "key"),
    "confusion_matrix_cells": "SELECT run_id, 0 AS row_idx, 0 AS col_idx, tn AS count FROM mx UNION ALL SELECT run_id, 0, 1, fp FROM mx UNION ALL "
                              "SELECT run_id, 1, 0, fn FROM mx UNION ALL SELECT run_id, 1, 1, tp FROM mx",
}


def _table_query(name: str):
    def run(spark, sf):
        out = DOC.run_tables(spark, _store(spark, sf))[name]
        return out.drop("params") if name == "trial_records" else out
    run.__name__ = f"q_table_{name}"
    run.__doc__ = f"The relational table {name} of the derived runs, read from their store."
    return run


for _name, _sql in TABLE_SQL.items():
    query(f"table_{_name}", Q.compose(_sql, ctes=_SEC))(_table_query(_name))


def _leaf_sql(path: str, src: str, text: str | None = None, number: str | None = None) -> str:
    """Leaves of one field: those with a value."""
    v = text or number
    return (f"SELECT run_id, {path} AS path, {text or 'CAST(NULL AS VARCHAR)'} AS text, "
            f"{f'CAST({number} AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS number FROM ({src}) x WHERE {v} IS NOT NULL")


def _document_sql() -> str:
    t, out = TABLE_SQL, []

    def fields(prefix: str, src: str, texts: str = "", numbers: str = "") -> None:
        out.extend(_leaf_sql(f"{prefix} || '{c}'", src, text=f'"{c}"') for c in texts.split())
        out.extend(_leaf_sql(f"{prefix} || '{c}'", src, number=f'"{c}"') for c in numbers.split())

    def length(path: str, section: str, src: str, where: str = "") -> None:
        out.append(f"SELECT s.run_id, '{path}#' AS path, CAST(NULL AS VARCHAR) AS text, CAST(coalesce(k.n, 0) AS DOUBLE) AS number "
                   f"FROM (SELECT run_id FROM ({section}) z {where}) s LEFT JOIN (SELECT run_id, count(*) AS n FROM ({src}) y GROUP BY run_id) k USING (run_id)")

    fields("''", t["runs"], "status", "loop_count")
    fields("'problem_spec.'", t["problem_specs"], "task_type target_column success_metric data_source", "metric_threshold")
    fields("'problem_spec.constraints.'", t["pipeline_constraints"], "", "max_tuning_trials interpretability_required max_loop_backs")
    fields("'data_profile.'", t["data_profiles"], "blocking_issue", "row_count column_count")
    fields("'data_profile.column_schema[' || ord || '].'", t["column_schemas"], "name dtype", "missing_pct is_target")
    fields("'data_profile.cleaning_actions_taken[' || ord || '].'", t["cleaning_actions"], "column action rationale")
    out.append(_leaf_sql("'data_profile.class_balance.' || class_label", t["class_balance_entries"], number="proportion"))
    out.append(_leaf_sql("'data_profile.warnings[' || ord || ']'", t["data_profile_warnings"], text="warning_text"))
    out.append(_leaf_sql("'data_profile.outlier_flags[' || ord || ']'", t["outlier_flags"], text="column_name"))
    for f, name in (("column_schema", "column_schemas"), ("cleaning_actions_taken", "cleaning_actions"), ("warnings", "data_profile_warnings"),
                    ("outlier_flags", "outlier_flags")):
        length(f"data_profile.{f}", t["data_profiles"], t[name])
    length("data_profile.class_balance", "SELECT DISTINCT run_id FROM s_class_balance", t["class_balance_entries"])
    fields("'eda_report.'", t["eda_reports"], "target_distribution_notes")
    out.append(_leaf_sql("'eda_report.correlation_summary.' || feature_name", t["feature_correlations"], number="correlation"))
    for kind in ("engineered", "dropped"):
        src = f"SELECT * FROM s_{kind}_features"
        fields(f"'eda_report.{kind}_features[' || ord || '].'", src, "name rationale")
        length(f"eda_report.{kind}_features", t["eda_reports"], src)
    for f, col in (("leakage_warnings", "warning_text"), ("data_quality_warnings", "warning_text"), ("final_feature_names", "feature_name")):
        out.append(_leaf_sql(f"'eda_report.{f}[' || ord || ']'", t[f], text=col))
        length(f"eda_report.{f}", t["eda_reports"], t[f])
    length("eda_report.correlation_summary", t["eda_reports"], t["feature_correlations"])
    fields("'tuning_result.'", t["tuning_results"], "metric_optimized convergence_notes", "best_cv_score converged search_budget_used search_budget_total")
    out.append(_leaf_sql("'tuning_result.best_params.' || param_name", t["tuning_best_params"], text="param_value"))
    length("tuning_result.best_params", t["tuning_results"], t["tuning_best_params"])
    mine = "SELECT * FROM tl WHERE run_id IN (SELECT run_id FROM rn)"
    fields("'tuning_result.search_history[' || trial_number || '].'", mine, "", "trial_number score")
    length("tuning_result.search_history", t["tuning_results"], mine)
    out.append(_leaf_sql("'tuning_result.search_history[' || trial_number || '].params.' || param_name",
                         t["trial_record_params"].replace("FROM tl", "FROM tl WHERE run_id IN (SELECT run_id FROM rn)"), text="param_value"))
    out.append(_leaf_sql("'tuning_result.search_history[' || trial_number || '].params#'", mine, number="3"))
    fields("'evaluation_report.'", t["evaluation_reports"], "metric_optimized pass_fail model_artifact_path", "metric_value metric_threshold")
    fields("'evaluation_report.failure_analysis.'", t["failure_analyses"], "summary recommended_next_step")
    out.append(_leaf_sql("'evaluation_report.test_metrics.' || metric_name", t["test_metric_entries"], number="value"))
    length("evaluation_report.test_metrics", t["evaluation_reports"], t["test_metric_entries"])
    out.append(_leaf_sql("'evaluation_report.residual_summary.' || key", t["residual_summary_entries"], number="value"))
    length("evaluation_report.residual_summary", "SELECT run_id FROM rs", t["residual_summary_entries"])
    out.append(_leaf_sql("'evaluation_report.confusion_matrix[' || row_idx || '][' || col_idx || ']'", t["confusion_matrix_cells"], number="count"))
    out += [_leaf_sql(f"'evaluation_report.confusion_matrix{p}#'", "SELECT run_id FROM mx", number="2") for p in ("", "[0]", "[1]")]
    place = "CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS INTEGER) AS i, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp"
    past, calls = f"SELECT *, {place} FROM h", f"SELECT *, 0 AS latency_ms, {place} FROM c"
    fields("'history[' || i || '].'", past, "timestamp stage event")
    length("history", t["runs"], past)
    fields("'trace[' || i || '].'", calls, "timestamp agent model", "prompt_tokens completion_tokens total_tokens latency_ms estimated_cost_usd")
    length("trace", t["runs"], calls)
    return "\nUNION ALL ".join(out)


_DOCUMENT_SQL = _document_sql()


@query("run_documents", Q.compose(_DOCUMENT_SQL + """
UNION ALL SELECT run_id, 'created_at', strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), NULL FROM rn
UNION ALL SELECT run_id, 'updated_at', strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f'), NULL FROM rn
UNION ALL SELECT run_id, 'total_cost_usd', NULL, CAST(round(sum(dcost), 6) AS DOUBLE) FROM c GROUP BY run_id
UNION ALL SELECT run_id, 'total_tokens', NULL, CAST(sum(total_tokens) AS DOUBLE) FROM c GROUP BY run_id""", ctes=_SEC))
def q_run_documents(spark, sf):
    """J1 + S7: every run's whole document, rebuilt from the store; one row per value in it."""
    return DOC.leaves(DOC.run_documents(spark, _store(spark, sf)))


@query("report_documents_json", Q.compose(_DOCUMENT_SQL, ctes=_SEC))
def q_report_documents_json(spark, sf):
    """every document as JSON text and back; one row per value in what came back."""
    texts = DOC.documents_json(DOC.run_documents(spark, _store(spark, sf)))
    return DOC.leaves(DOC.documents_from_json(texts).drop("invalid"))


@query("decision_counts", Q.compose(
    """SELECT rn.run_id, CASE WHEN e.run_id IS NOT NULL THEN coalesce(k.n, 0) END AS n_kept, CASE WHEN e.run_id IS NOT NULL THEN coalesce(g.n, 0) END
       AS n_engineered, CASE WHEN e.run_id IS NOT NULL THEN coalesce(d.n, 0) END AS n_dropped,
       CASE WHEN p.run_id IS NOT NULL THEN coalesce(a.n, 0) END AS n_actions
       FROM rn LEFT JOIN s_eda e USING (run_id) LEFT JOIN s_profile p USING (run_id)
       LEFT JOIN (SELECT run_id, count(*) AS n FROM s_final_feature_names GROUP BY run_id) k USING (run_id)
       LEFT JOIN (SELECT run_id, count(*) AS n FROM s_engineered_features GROUP BY run_id) g USING (run_id)
       LEFT JOIN (SELECT run_id, count(*) AS n FROM s_dropped_features GROUP BY run_id) d USING (run_id)
       LEFT JOIN (SELECT run_id, count(*) AS n FROM s_cleaning_actions_taken GROUP BY run_id) a USING (run_id)""", ctes=_SEC))
def q_decision_counts(spark, sf):
    """Kept, engineered, dropped and action counts of every stored run."""
    return DOC.decision_counts(spark, _store(spark, sf))


# ====================================================================== spec check, whole run, streams, synthetic

from tabml.plans import specs as SPC  # noqa: E402

_KNOWN = "[" + ", ".join(f"'{s}'" for s in sorted("builtin:" + n for n in SRC.BUILTINS)) + "]"
_FITS = (f"CASE WHEN task_type = 'classification' THEN success_metric IN ('accuracy', 'f1', 'precision', 'recall', 'roc_auc') "
         f"ELSE success_metric IN ('rmse', 'mae', 'r2') END")
_VALID = ("(data_source LIKE '%.csv' OR data_source LIKE '%.parquet' OR data_source IN ("
          + ", ".join(f"'builtin:{n}'" for n in SRC.BUILTINS) + "))")
_MISSING = ("concat_ws(',', CASE WHEN task_type IS NULL THEN 'task_type' END, CASE WHEN target_column IS NULL THEN "
            "'target_column' END, CASE WHEN success_metric IS NULL THEN 'success_metric' END, CASE WHEN metric_threshold "
            "IS NULL THEN 'metric_threshold' END, CASE WHEN dataset IS NULL AND data_source IS NULL THEN 'data_source' END)")


@query("spec_check", Q.compose(
    f"""SELECT request_id, CASE WHEN mf IS NULL THEN 'spec' ELSE 'needs_clarification' END AS outcome, mf AS missing_fields,
       q AS question FROM (SELECT request_id,
         CASE WHEN bad THEN 'target_column' WHEN unclear IS NOT NULL THEN unclear WHEN miss <> '' THEN miss
              WHEN dataset IS NULL AND NOT {_VALID} THEN 'data_source' WHEN NOT {_FITS} THEN 'success_metric' END AS mf,
         CASE WHEN bad THEN 'No column is called ''' || target_column || '''. Columns: ' || real || '.'
              WHEN unclear IS NOT NULL THEN 'Please state what is still open.'
              WHEN miss <> '' THEN 'Still needed: ' || replace(miss, ',', ', ') || '.'
              WHEN dataset IS NULL AND NOT {_VALID} THEN 'Unknown data source ''' || data_source || '''. Give one of {_KNOWN.replace("'", "''")} or a .csv or .parquet path.'
              WHEN NOT {_FITS} THEN '''' || success_metric || ''' does not measure ' || task_type || '; name a metric that does.' END AS q
       FROM (SELECT r.*, {_MISSING} AS miss,
               r.dataset IS NOT NULL AND r.target_column IS NOT NULL AND NOT EXISTS
                 (SELECT 1 FROM ic WHERE ic.dataset = r.dataset AND ic.column_name = r.target_column) AS bad,
               (SELECT '[' || string_agg('''' || column_name || '''', ', ' ORDER BY column_name) || ']' FROM ic
                WHERE ic.dataset = r.dataset) AS real
             FROM rq r) a) b""",
    ctes=[_INFO, ("rq", REQUESTS_SQL.replace("{events}", "events"))]))
def q_spec_check(spark, sf):
    req = spark.sql(REQUESTS_SQL, events=V.table(spark, sf, "events"))
    return SPC.spec_check(req, _columns_table(spark, sf))


@query("full_run")
def q_full_run(spark, sf):
    """M9: the whole chain on the builtin orders table, with the default trials and loop-backs."""
    from tabml.plans.pipeline import run_pipeline
    spec = ProblemSpec("classification", "is_p", "f1", 0.9, "builtin:orders_status")
    run = run_pipeline(spark, spec, run_id="full-run", base_dir=sf, key="o_orderkey")
    ev = run.evaluation_report
    return spark.createDataFrame([(run.run_id, run.status, run.loop_count, len(run.eda_report.final_feature_names),
                                   ev.metric_value if ev else None, ev.pass_fail if ev else None, len(run.history))],
                                 "run_id string, status string, loop_count int, n_features int, metric_value double, "
                                 "pass_fail string, n_history int")


@query("stream_score", _flag_long_sql("orders_labeled", []))
def q_stream_score(spark, sf):
    """The flagship plan (fitted on batch train rows) applied to orders as a file stream of
    several micro-batches; rows equal the batch transform (long form as in apply_features)."""
    from tabml.streaming.score import stream_score
    _, model, _ = flagship(spark, sf)
    names = model.plan.final_feature_names
    staged = scratch_path(spark, "stream-src")
    V.orders_labeled(spark, sf).withColumn("row_key", F.col("o_orderkey")).repartition(4).write.parquet(staged)
    out = stream_score(spark, staged, spark.read.parquet(staged).schema,
                       FE.FeaturePlanModel(model.plan, passthrough=("row_key",)),
                       scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"))
    return out.unpivot(["row_key"], names, "feature", "value")


@query("stream_run_status", Q.compose(
    """SELECT run_id, count(*) AS n_events, arg_max(event, ts) AS last_event,
       count(*) FILTER (WHERE contains(event, 'fail ->')) AS loop_backs FROM h GROUP BY run_id""", ctes=[_H]))
def q_stream_run_status(spark, sf):
    """R2: history replayed as a file stream in several micro-batches; the final status table equals
    the batch aggregate."""
    from tabml.streaming.status import stream_run_status
    staged = scratch_path(spark, "history-src")
    RV.history(spark, sf).repartition(4, "seq").write.parquet(staged)
    st = stream_run_status(spark, staged, spark.read.parquet(staged).schema, scratch_path(spark, "status"),
                           scratch_path(spark, "status-ckpt"))
    return st.select("run_id", "n_events", "last_event", "loop_backs")


@query("stream_live_status", Q.compose(
    """SELECT run_id, n_events, last_event, loop_backs, n_calls, total_tokens, total_cost_usd FROM
       (SELECT run_id, count(*) AS n_events, arg_max(event, struct_pack(ts := ts, seq := seq)) AS last_event,
        count(*) FILTER (WHERE contains(event, 'fail ->')) AS loop_backs FROM h GROUP BY run_id) a
       JOIN (SELECT run_id, count(*) AS n_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        CAST(round(sum(dcost), 6) AS DOUBLE) AS total_cost_usd FROM c GROUP BY run_id) t USING (run_id)""", ctes=[_H, _TR, _COST]))
def q_stream_live_status(spark, sf):
    """R2 with both sources: history and model calls as two file streams of several micro-batches each."""
    from tabml.streaming.status import stream_live_status
    at = {}
    for name, rows in (("history", RV.history(spark, sf)), ("trace", RV.trace(spark, sf))):
        path = scratch_path(spark, f"{name}-src")
        rows.repartition(3, "seq").write.parquet(path)
        at[name] = (path, spark.read.parquet(path).schema)
    st = stream_live_status(spark, *at["history"], *at["trace"], scratch_path(spark, "live"), scratch_path(spark, "live-ckpt"))
    return st.select("run_id", "n_events", "last_event", "loop_backs", "n_calls", "total_tokens", "total_cost_usd")


@query("escalation_analysis", Q.compose(
    """SELECT run_id, coalesce(CASE WHEN pass_fail = 'fail' THEN 'threshold missed (next step: ' || step || ')' END, last_escalation) AS reason
       FROM (SELECT run_id, arg_max(event, struct_pack(ts := ts, seq := seq)) FILTER (WHERE contains(lower(event), 'escalat')) AS last_escalation
             FROM h GROUP BY run_id) l JOIN ev USING (run_id)""", ctes=_SEC))
def q_escalation_analysis(spark, sf):
    """W8 with the analysis of the stored evaluation reports: it goes before the last line that mentions an escalation."""
    analysis = DOC.run_tables(spark, _store(spark, sf))["failure_analyses"]
    return RU.escalation_reason(RV.history(spark, sf), analysis)


@query("synth_customers")
def q_synth_customers(spark, sf):
    """One synthetic customer per row of the customer table, leaky variant included."""
    from tabml.sources.synth import synth_customers
    return synth_customers(V.table(spark, sf, "customer"), "c_custkey", leaky=True)


@query("report_json", "SELECT to_json(struct_pack(label := label, share := share)) AS json FROM "
                     "(SELECT o_orderstatus AS label, round(count(*) / sum(count(*)) OVER (), 4) AS share "
                     "FROM orders GROUP BY o_orderstatus) t")
def q_report_json(spark, sf):
    """a report as JSON for review (class balance of orders, one JSON object per class)."""
    bal = P.class_balance_table(V.table(spark, sf, "orders"), "o_orderstatus")
    return bal.select(F.to_json(F.struct("label", "share")).alias("json"))


@query("matrix_flatten", Q.compose(
    """SELECT CAST(l1.idx AS INTEGER) AS row_idx, CAST(l2.idx AS INTEGER) AS col_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS count
       FROM lab l1 CROSS JOIN lab l2 LEFT JOIN cnt c ON c.label = l1.lbl AND c.prediction = l2.lbl""", ("predictions",),
    [("cnt", "SELECT label, prediction, count(*) AS n FROM predictions GROUP BY ALL"),
     ("lab", "SELECT lbl, dense_rank() OVER (ORDER BY lbl) - 1 AS idx FROM (SELECT label AS lbl FROM predictions "
             "UNION SELECT prediction FROM predictions) u")]))
def q_matrix_flatten(spark, sf):
    """a 2-D matrix as (row, col, count) cells, zero-filled over the label union."""
    cells = M.confusion_cells(V.predictions(spark, sf), "label", "prediction")
    return cells.select("row_idx", "col_idx", "count")


@query("column_fate", "SELECT CAST(NULL AS VARCHAR) AS column_name WHERE false")
def q_column_fate(spark, sf):
    """Source columns of the flagship that no decision accounts for (must be none)."""
    _, _, d = flagship(spark, sf)
    accounted = FE.decisions_frame(spark, d).select(F.col("source_column").alias("column_name"))
    src = spark.createDataFrame([(c,) for c in V.orders_labeled(spark, sf).columns if c != "is_p"], "column_name string")
    return src.join(accounted, "column_name", "left_anti")


# ====================================================================== remaining inventory keys

@query("apply_fills", Q.compose(
    """SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gaps)), 6) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT o_orderpriority FROM gaps WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
                ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM gaps""", ("gaps",)))
def q_apply_fills(spark, sf):
    """One-row statistics (median, mode) applied to every row as literals (no join, no shuffle)."""
    g = V.gaps(spark, sf)
    fills = {**P.median_fills(g, ["o_totalprice"]), **P.mode_fills(g, ["o_orderpriority"])}
    return P.apply_fills(g, fills).select("o_orderkey", r6("o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query("est_cost", Q.compose("SELECT run_id, seq, prompt_tokens, completion_tokens, estimated_cost_usd FROM c",
                             ctes=[_TR, _COST]))
def q_est_cost(spark, sf):
    """tokens / 1000 x rate per call, rounded to 6 places."""
    return RU.with_cost(RV.trace(spark, sf)).select("run_id", "seq", "prompt_tokens", "completion_tokens",
                                                    "estimated_cost_usd")


@query("keep_project", Q.compose(
    """SELECT CAST(row_number() OVER (ORDER BY CASE WHEN kind = 'interaction' THEN 1 ELSE 0 END, position) - 1 AS INTEGER)
       AS position, feature FROM fd WHERE decision IN ('kept', 'kept_leakage_warning')""", ("orders_labeled",),
    Q.split_ctes("orders_labeled", "o_orderkey", "is_p") + [("fd", _FLAG_DECISIONS)]))
def q_keep_project(spark, sf):
    """P10: final columns in candidate order, the interaction last."""
    _, model, _ = flagship(spark, sf)
    return spark.createDataFrame(list(enumerate(model.plan.final_feature_names)), "position int, feature string")


@query("label_union", Q.compose("SELECT actual AS lbl FROM multiclass_predictions UNION SELECT predicted "
                                "FROM multiclass_predictions", ("multiclass_predictions",)))
def q_label_union(spark, sf):
    """Labels present in actual or predicted."""
    counts = M.pair_counts(V.multiclass_predictions(spark, sf), "actual", "predicted")
    return M.label_union(counts)


@query("target_present", Q.compose(
    "SELECT r.request_id, r.dataset, r.target_column, h.hit IS NOT NULL AS present, "
    "CASE WHEN h.hit IS NULL THEN 'Target column ''' || r.target_column || ''' not present in data.' END AS blocking_issue "
    "FROM rq r LEFT JOIN (SELECT dataset, column_name, true AS hit FROM ic) h "
    "ON h.dataset = r.dataset AND h.column_name = r.target_column "
    "WHERE r.dataset IS NOT NULL AND r.target_column IS NOT NULL",
    ctes=[_INFO, ("rq", REQUESTS_SQL.replace("{events}", "events"))]))
def q_target_present(spark, sf):
    """P4 over every candidate spec (one per user in ``events``): a target that is not a column of its
    dataset blocks the run with the profile's message. The single-spec form is ``clean_and_profile``,
    which stops before any statistic (unit-tested)."""
    req = spark.sql(REQUESTS_SQL, events=V.table(spark, sf, "events"))
    req = req.where(F.col("dataset").isNotNull() & F.col("target_column").isNotNull())
    return P.target_present_table(req, _columns_table(spark, sf)).select(
        "request_id", "dataset", "target_column", "present", "blocking_issue")


def _flagship_forest(spark, sf):
    from tabml.operators import train as T
    X, _, feats = _flagship_folds(spark, sf)
    labels = T.class_labels(X, "is_p")
    data = T.with_label(X, FLAG_SPEC, labels)
    model = T.forest_pipeline(FLAG_SPEC, feats, T.DEFAULT_PARAMS).fit(data.where(~F.col("is_test")))
    return model, data, labels, feats


@query("rf_train")
def q_rf_train(spark, sf):
    """M3: forest (100 trees, depth 8, min split 4, seed 42) on the flagship train rows; one row per
    feature with its importance."""
    model, _, _, feats = _flagship_forest(spark, sf)
    rf = model.stages[-1]
    imp = rf.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v), rf.getNumTrees, rf.totalNumNodes) for f, v in zip(feats, imp)],
                                 "feature string, importance double, num_trees int, total_nodes int")


@query("rf_predict")
def q_rf_predict(spark, sf):
    """M4: label-space predictions and P(class 1) for the test rows."""
    from tabml.operators import train as T
    model, data, labels, _ = _flagship_forest(spark, sf)
    preds = T.predict(model, data.where(F.col("is_test")), FLAG_SPEC, labels)
    return preds.select(F.col("row_key").alias("o_orderkey"), "pred", "score")


@query("reuse", """SELECT 'deduped' AS piece, count(*) AS n_rows, true AS reused FROM (SELECT DISTINCT * FROM orders WHERE o_orderstatus IS NOT NULL) d
       UNION ALL SELECT 'X', count(*), true FROM (SELECT DISTINCT * FROM orders WHERE o_orderstatus IS NOT NULL) d
       UNION ALL SELECT 'other run', NULL, false""")
def q_reuse(spark, sf):
    """One tool profiles, the next takes its frame from the shared folder through a cache object of its own, as another session
    would; rows of each stored piece, and a run without pieces."""
    from tabml.plans.tools import DurableCache, engineer_features_tool, profile_dataset_tool
    root = scratch_path(spark, "stages")
    at = dict(data_source="builtin:orders_status", target_column="is_p", task_type="classification", base_dir=sf)
    profile_dataset_tool(spark, cache=DurableCache(spark, root), run_id="r1", **at)
    engineer_features_tool(spark, cache=DurableCache(spark, root), run_id="r1", **at)
    later, rows = DurableCache(spark, root), []
    for piece, run in (("deduped", "r1"), ("X", "r1"), ("other run", "r2")):
        got = later.get(run, "X" if run == "r2" else piece)
        rows.append((piece, got[0].count() if got else None, got is not None))
    return spark.createDataFrame(rows, "piece string, n_rows long, reused boolean")


@query("round_text", Q.compose(
    "SELECT 'o_totalprice' AS \"column\", 'median_imputation' AS action, printf('%.1f%% of the values were gaps, "
    "filled with the median %.3f.', mp_price, med) AS rationale FROM st WHERE mp_price > 0 "
    "UNION ALL SELECT 'o_orderpriority', 'mode_imputation', printf('%.1f%% of the values were gaps, filled with the "
    "commonest value ''%s''.', mp_prio, mode) FROM st WHERE mp_prio > 0",
    ("gaps",), [("g", "SELECT DISTINCT * FROM gaps WHERE o_orderstatus IS NOT NULL"),
                ("st", "SELECT round(avg(CAST(o_totalprice IS NULL OR isnan(o_totalprice) AS INTEGER)) * 100, 2) AS mp_price, "
                       "round(avg(CAST(o_orderpriority IS NULL AS INTEGER)) * 100, 2) AS mp_prio, "
                       "quantile_cont(o_totalprice, 0.5) AS med, (SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL "
                       "GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1) AS mode FROM g")]))
def q_round_text(spark, sf):
    """the rationale texts of a profile (percent and fixed-point formatting on collected summaries)."""
    _, prof = P.clean_and_profile(V.gaps(spark, sf), _spec("classification", "o_orderstatus"))
    return spark.createDataFrame([(a.column, a.action, a.rationale) for a in prof.cleaning_actions_taken],
                                 "column string, action string, rationale string")


# ====================================================================== documents / labels / embeddings

SOURCES = [f"src{i}" for i in range(20)]
SOURCES_SORTED = sorted(SOURCES)
LANGS = ["de", "en", "es", "fr"]
_DOCS = ("dl", "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
               "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


def _docs_labeled(spark, sf):
    """documents left-joined with their (partial) labels; labels is one row per doc_id, so the join
    keeps one row per document. Spark picks a broadcast of labels only when its size is small."""
    d = V.table(spark, sf, "documents")
    lab = V.table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


@query("one_hot_boundary", Q.compose("SELECT * FROM fd", ctes=[_DOCS, ("fd", Q.decisions_sql(
    "dl", "n_chars", ["doc_id", "quality", "toxic"],
    [("text", "categorical", None), ("lang", "categorical", LANGS), ("source", "categorical", SOURCES_SORTED)]))]))
def q_one_hot_boundary(spark, sf):
    """F2 at the boundary: ``source`` has exactly 20 values (kept, 20 dummies), ``text`` is dropped as
    high-cardinality, the labels' gaps stay gaps (pairwise-complete correlation)."""
    _, _, d = FE.fit_plan(_docs_labeled(spark, sf), _spec("regression", "n_chars"))
    return FE.decisions_frame(spark, d)


@query("nested_dropped", Q.compose("SELECT * FROM fd", ctes=[("fd", Q.decisions_sql(
    "embeddings", "label", ["vec_id"], [("embedding", "other", None)]))]))
def q_nested_dropped(spark, sf):
    """Array columns are out of scope as features: dropped with a reason instead of failing."""
    _, _, d = FE.fit_plan(V.table(spark, sf, "embeddings"), _spec("classification", "label"))
    return FE.decisions_frame(spark, d)
