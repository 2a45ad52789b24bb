"""Per-column figures from one (column, value) table against plain counting."""

import collections
import datetime as dt
import random
from decimal import Decimal

from tabml.operators.colvalues import column_summaries
from tabml.operators import profile as P

SCHEMA = ("i long, `a.b` string, d double, f float, m decimal(20,4), b boolean, day date, ts timestamp_ntz, none string")


def rows(n=400):
    rng = random.Random(4)
    nan = float("nan")
    out = []
    for _ in range(n):
        out.append((rng.choice([2**53 + 1, 2**53, -5, None, rng.randrange(100)]), rng.choice(["x", "é", "", None, "x y"]),
                    rng.choice([nan, None, -0.5, 1e10, rng.random()]), rng.choice([nan, 0.25, None]), rng.choice([Decimal("1.2500"), Decimal("-3.1000"), None]),
                    rng.choice([True, False, None]), rng.choice([dt.date(1969, 12, 31), dt.date(2024, 2, 29), None]),
                    rng.choice([dt.datetime(1969, 1, 1, 0, 0, 0, 5), dt.datetime(2024, 1, 1), None]), None))
    return out


def missing(v):
    return v is None or v != v


def test_against_plain_counting(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = column_summaries(df, df.columns, 5)
    texts = {c: [r[0] for r in df.selectExpr(f"cast(`{c}` as string)").collect()] for c in ("i", "a.b", "m", "b")}
    for k, c in enumerate(df.columns):
        values = [r[k] for r in data if not missing(r[k])]
        s = got[c]
        assert (s.rows, s.missing, s.distinct) == (len(data), len(data) - len(values), len(set(values))), c
        assert s.smallest == sorted(set(values))[:5], c
        if c in texts:
            counts = collections.Counter(t for t in texts[c] if t is not None)
            assert s.mode == min(counts, key=lambda t: (-counts[t], t)), c
    assert got["none"].mode is None and got["none"].smallest == []


def test_empty_table_and_no_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert column_summaries(df, []) == {} and all((s.rows, s.distinct, s.smallest) == (0, 0, []) for s in column_summaries(df, df.columns, 3).values())
    assert [r["unique_count"] for r in P.peek_columns(spark, df).collect()] == [0] * 9


def test_rows_are_read_once(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    seen = []
    real = type(df).collect
    type(df).collect = lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or real(self)
    try:
        P.peek_columns(spark, df).count()
    finally:
        type(df).collect = real
    assert len(seen) == 1   # one job over the table
