"""A3, A4, A6, F2 from one table: every (column, value) of some columns with its count.

The rows are read once. Values of all columns are stacked and counted in one aggregate with map-side combine, so a hot value
costs one row a task; per-column figures are aggregates of that table, and the smallest values of a column come from a
window with a partial limit, so no column's values meet in one task or on the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.functions.missing import nullify, quoted

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass
class ColumnSummary:
    """One column: rows, missing ones (null, NaN), distinct values, the commonest value as text (the smallest text of equally common
    ones), and its smallest values in their own type and order."""

    rows: int
    missing: int
    distinct: int
    mode: str | None
    smallest: list


def _keys(name: str, kind: T.DataType) -> tuple[Column, Column, Column]:
    """(number, whole number, text): a value's order is that of the three; with its type they give the value back."""
    c = F.col(quoted(name))
    number, whole = F.lit(None).cast("double"), F.lit(None).cast("long")
    if isinstance(kind, _WHOLE):
        number, whole = c.cast("double"), c.cast("long")
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        number = c.cast("double")
    elif isinstance(kind, T.BooleanType):
        whole = c.cast("long")
    elif isinstance(kind, T.DateType):
        whole = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.unix_micros(c.cast("timestamp"))
    return number, whole, c.cast("string")


def _value(kind: T.DataType, number, whole, text):
    if isinstance(kind, _WHOLE):
        return whole
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return number
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    if isinstance(kind, T.BooleanType):
        return bool(whole)
    if isinstance(kind, T.DateType):
        return dt.date(1970, 1, 1) + dt.timedelta(days=whole)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _EPOCH + dt.timedelta(microseconds=whole)
    return text


def column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(k, number, whole, text, n): column by place in ``cols``, value (all null: missing), rows that hold it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    entry = lambda i, c: F.struct(F.lit(i).alias("k"), *[e.alias(a) for e, a in zip(_keys(c, kinds[c]), ("number", "whole", "text"))])
    stacked = nullify(df).select(F.explode(F.array(*[entry(i, c) for i, c in enumerate(cols)])).alias("s")).select("s.*")
    return stacked.groupBy("k", "number", "whole", "text").agg(F.count(F.lit(1)).alias("n"))


def column_summaries(df: DataFrame, cols: list[str], smallest: int = 0) -> dict[str, ColumnSummary]:
    """Figures of each column and its ``smallest`` first values: columns x smallest rows reach the driver."""
    if not cols:
        return {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = column_values(df, cols)
    there = F.col("text").isNotNull()
    figures = values.groupBy("k").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing"),
                                      F.count("text").alias("distinct"), F.min_by("text", F.when(there, F.struct(-F.col("n"), F.col("text")))).alias("mode"))
    if smallest:
        order = Window.partitionBy("k").orderBy("number", "whole", "text")
        first = values.where(there).withColumn("at", F.row_number().over(order)).where(F.col("at") <= smallest)
        listed = first.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "number", "whole", "text"))).alias("first"))
        figures = figures.join(listed, "k", "left")   # both sides read one shuffled table
    out = {c: ColumnSummary(0, 0, 0, None, []) for c in cols}
    for r in figures.collect():
        kind = kinds[cols[r["k"]]]
        first = (r["first"] or []) if smallest else []
        out[cols[r["k"]]] = ColumnSummary(r["rows"], r["missing"], r["distinct"], r["mode"], [_value(kind, v["number"], v["whole"], v["text"]) for v in first])
    return out
