"""Missing-value policy: "missing" means null or NaN, as in the reference's isna()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    """A column name as a path of one step: names with dots (category values, file headers) need quotes."""
    return "`" + name.replace("`", "``") + "`" if "." in name or "`" in name else name


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, _FLOATS)


def is_missing(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Null, or NaN for floating columns."""
    col = F.col(quoted(c)) if isinstance(c, str) else c
    if dtype is not None and not is_float_type(dtype):
        return col.isNull()
    if dtype is None:
        return col.isNull()
    return col.isNull() | F.isnan(col)


def nullify(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float/double column so Spark's null handling equals isna().

    A pure projection: stays inside whole-stage codegen, no shuffle, type unchanged.
    """
    cols = []
    changed = False
    for f in df.schema.fields:
        if is_float_type(f.dataType):
            cols.append(F.nanvl(F.col(quoted(f.name)), F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            cols.append(F.col(quoted(f.name)))
    return df.select(*cols) if changed else df
