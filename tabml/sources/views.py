"""Derived inputs for checks: the situations the reference tests with (gaps, duplicates, constant,
leaking and boolean columns, rare classes, fixed predictions), re-created over the whole tables of a
data folder so their size grows with the data. Each has an identical DuckDB form in the oracle."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def gaps(spark, sf_dir) -> DataFrame:
    """orders with injected gaps: o_totalprice every 7th key, o_orderpriority every 8th key."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_orderdate",
                    F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                    F.when(F.col("o_orderkey") % 8 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def duplicates(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.unionAll(o.where(F.col("o_orderkey") % 10 == 0))


def flagged(spark, sf_dir) -> DataFrame:
    """orders + a constant, a leak of o_totalprice and a boolean."""
    o = table(spark, sf_dir, "orders")
    return o.select("*", F.lit(1.0).cast("double").alias("constant_flag"),
                    (F.col("o_totalprice") * 2 + 1).alias("leaked"),
                    (F.col("o_totalprice") > 100000).alias("is_large"))


def rare(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("rare", F.when(F.col("o_orderkey") % 20 == 0, 1).otherwise(0))


def orders_labeled(spark, sf_dir) -> DataFrame:
    """orders with the flagship target: is the order status 'P'?"""
    o = table(spark, sf_dir, "orders")
    return o.withColumn("is_p", (F.col("o_orderstatus") == "P").cast("int"))


def predictions(spark, sf_dir) -> DataFrame:
    """Fixed binary predictions on lineitem (no model needed, so the oracle is exact)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_quantity") > 25).cast("int").alias("label"),
                     (F.col("l_discount") > 0.05).cast("int").alias("prediction"),
                     F.round("l_discount", 2).alias("score"),
                     F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * 1500.0).alias("y_pred"))


def multiclass_predictions(spark, sf_dir) -> DataFrame:
    """orders: actual status vs a rule on priority; 'X' is predicted but never actual."""
    o = table(spark, sf_dir, "orders")
    pred = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "F")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "O")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "P").otherwise("X"))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("actual"), pred.alias("predicted"))


# ---- the same inputs as DuckDB common table expressions ----
SQL_VIEWS = {
    "gaps": """SELECT o_orderkey, o_orderstatus, o_orderdate,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""",
    "duplicates": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0",
    "flagged": """SELECT *, CAST(1.0 AS DOUBLE) AS constant_flag, o_totalprice * 2 + 1 AS leaked,
       o_totalprice > 100000 AS is_large FROM orders""",
    "rare": "SELECT *, CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS rare FROM orders",
    "orders_labeled": "SELECT *, CAST(o_orderstatus = 'P' AS INTEGER) AS is_p FROM orders",
    "predictions": """SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS label,
       CAST(l_discount > 0.05 AS INTEGER) AS prediction, round(l_discount, 2) AS score,
       l_extendedprice AS y, l_quantity * CAST(1500.0 AS DOUBLE) AS y_pred FROM lineitem""",
    "multiclass_predictions": """SELECT o_orderkey, o_orderstatus AS actual,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' WHEN o_orderpriority = '3-MEDIUM' THEN 'O'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'P' ELSE 'X' END AS predicted FROM orders""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the named CTEs."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
