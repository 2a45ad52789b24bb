"""datetime parts, named ``c__year``, ``c__month``, ``c__day_of_week`` (Mon=0), ``c__is_weekend``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabml.functions.missing import quoted

PART_SUFFIXES = ("__year", "__month", "__day_of_week", "__is_weekend")


def part_names(c: str) -> list[str]:
    return [c + s for s in PART_SUFFIXES]


def datetime_parts(c: str) -> list[Column]:
    """All four as double. A missing date gives missing year/month/day_of_week, but is_weekend 0.0:
    the reference compares a missing weekday with 5, which is false."""
    col = F.col(quoted(c))
    wd = F.weekday(col)  # Monday = 0
    return [
        F.year(col).cast("double").alias(c + "__year"),
        F.month(col).cast("double").alias(c + "__month"),
        wd.cast("double").alias(c + "__day_of_week"),
        F.coalesce(wd >= 5, F.lit(False)).cast("double").alias(c + "__is_weekend"),
    ]
