"""Column classes (numeric, bool, datetime, categorical, other): a pure function of the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NUMERIC = "numeric"
BOOL = "bool"
DATETIME = "datetime"
CATEGORICAL = "categorical"
OTHER = "other"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                  T.DecimalType)
_DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType)


def column_class(dt: T.DataType) -> str:
    """Bool is checked first, datetime before categorical (text that looks like a date is text)."""
    if isinstance(dt, T.BooleanType):
        return BOOL
    if isinstance(dt, _DATETIME_TYPES):
        return DATETIME
    if isinstance(dt, _NUMERIC_TYPES):
        return NUMERIC
    if isinstance(dt, _TEXT_TYPES):
        return CATEGORICAL
    return OTHER


def column_classes(df: DataFrame) -> list[tuple[str, str, str]]:
    """[(column, class, spark type)] in column order; zero jobs."""
    return [(f.name, column_class(f.dataType), f.dataType.simpleString()) for f in df.schema.fields]


def column_classes_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """P2 as a table (column_name, column_class, dtype, position)."""
    rows = [(n, c, t, i) for i, (n, c, t) in enumerate(column_classes(df))]
    schema = "column_name string, column_class string, dtype string, position int"
    return spark.createDataFrame(rows, schema)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns, bool excluded."""
    return [n for n, c, _ in column_classes(df) if c == NUMERIC and n not in exclude]


def columns_of(df: DataFrame, cls: str, exclude: tuple[str, ...] = ()) -> list[str]:
    return [n for n, c, _ in column_classes(df) if c == cls and n not in exclude]
