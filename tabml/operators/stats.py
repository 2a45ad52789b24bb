"""Shared statistics: fused wide aggregates, guarded correlation, exact quantiles at any size."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wide aggregates are split into chunks so generated code stays under the JVM method-size limit.
AGG_CHUNK = 48
# Exact `percentile` keeps a value->count map per aggregation buffer, and a global aggregate merges
# every task's map in one final task: the merge work is bounded by the number of rows, not by the
# number of distinct values. So it is used only on inputs of at most PERCENTILE_MAX_ROWS rows, with
# columns packed so one job's maps hold at most PERCENTILE_BUDGET entries. Larger inputs use the
# narrowing histogram search (distributed partial aggregates, a few scans for all columns together).
PERCENTILE_MAX_ROWS = 250_000
PERCENTILE_BUDGET = 8_000_000
HIST_BUCKETS = 4096
# a search range holding at most this many rows is finished by counting its distinct values
FINAL_RANGE_ROWS = 20_000
MAX_ROUNDS = 256  # a factor of HIST_BUCKETS a round: the widest range of doubles takes 175


def wide_agg(df: DataFrame, exprs: Sequence[Column]) -> dict:
    """Evaluate many scalar aggregates; one job per chunk of AGG_CHUNK expressions."""
    out: dict = {}
    exprs = list(exprs)
    for i in range(0, len(exprs), AGG_CHUNK):
        chunk = exprs[i:i + AGG_CHUNK]
        if not chunk:
            continue
        row = df.agg(*chunk).first()
        out.update(row.asDict())
    return out


CATALOG_BROADCAST_ROWS = 100_000   # catalogs / lookup tables below this many rows are broadcast


def broadcast_if_small(df: DataFrame, limit: int = CATALOG_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when it has at most ``limit`` rows (checked with a bounded count), else df.

    Used for catalogs joined on keys with few values (dataset, label), where a shuffle join would
    send each key's rows to one task."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def abs_corr(x: Column, y: Column) -> Column:
    """|Pearson r| over pairwise-complete rows; null when undefined (constant column, < 2 rows).

    ``corr`` is avoided: under ANSI mode a zero spread raises instead of returning null.
    """
    x_pc = F.when(y.isNotNull(), x)
    y_pc = F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x_pc) * F.stddev_samp(y_pc))
    return F.abs(r)


def rounded_corr(value) -> float:
    """NaN / undefined -> 0.0, else abs rounded to 4 digits (every later comparison uses this)."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return 0.0
    return round(abs(float(value)), 4)


# --------------------------------------------------------------------------------------------
# Exact quantiles (linear interpolation, like numpy / pandas / DuckDB quantile_cont)
# --------------------------------------------------------------------------------------------

def _cell(v: Column, lo: float, hi: float) -> Column:
    """Histogram cell of a value in [lo, hi]; lo and hi never share one. Infinities have cells of their own, and a range
    too wide for a double (or with an infinite end) is cut on a logarithmic scale."""
    a, b, x = lo, hi, v
    if math.isinf(hi - lo):
        a, b = (math.copysign(math.log1p(min(abs(e), sys.float_info.max)), e) for e in (lo, hi))
        x = F.signum(v) * F.log1p(F.abs(v))
    inside = F.greatest(F.least(F.width_bucket(x, F.lit(a), F.lit(b), F.lit(HIST_BUCKETS)), F.lit(HIST_BUCKETS)), F.lit(1))
    return (F.when(v == F.lit(-math.inf), F.lit(0.0)).when(v == F.lit(math.inf), F.lit(HIST_BUCKETS + 1.0))
            .otherwise(inside.cast("double")))


def kth_smallest(df: DataFrame, targets: Sequence[tuple[str, int]], bounds: dict) -> dict:
    """{(column, k): k-th smallest (0-based) non-null value of the column, as float}.

    All targets narrow together: each round is ONE scan that emits, for every open search range
    (column, lo, hi), the row's histogram bucket, and one partial aggregate counts (range, bucket)
    cells, so the shuffle carries at most ranges x HIST_BUCKETS rows whatever the data size. The
    driver keeps, per target, the bucket holding rank k (invariant: exactly ``below`` values are
    < lo and the k-th value lies in [lo, hi]). A range with few rows is finished by counting its
    distinct values (still an aggregate; at most FINAL_RANGE_ROWS rows per range reach the driver).
    ``bounds``: {column: (min, max)} of the non-null values.
    """
    state = {t: (float(bounds[t[0]][0]), float(bounds[t[0]][1]), 0, False) for t in targets}
    done: dict = {}
    for _ in range(MAX_ROUNDS):
        for t, (lo, hi, _b, _f) in list(state.items()):
            if t not in done and lo == hi:
                done[t] = lo
        open_ = [t for t in state if t not in done]
        if not open_:
            return done
        ranges: dict = {}
        for t in open_:
            lo, hi, _b, final = state[t]
            ranges.setdefault((t[0], lo, hi, final), len(ranges))
        cells = []
        for (c, lo, hi, final), rid in ranges.items():
            v = F.col(c).cast("double")
            key = v if final else _cell(v, lo, hi)
            cells.append(F.when(v.between(F.lit(lo), F.lit(hi)),
                                F.struct(F.lit(rid).alias("r"), key.alias("b"), v.alias("v"))))
        stacked = df.select(F.explode(F.array(*cells)).alias("s")).where(F.col("s").isNotNull())
        hist: dict = {}
        for row in (stacked.groupBy(F.col("s.r").alias("r"), F.col("s.b").alias("b"))
                    .agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi"))
                    .collect()):
            hist.setdefault(row["r"], []).append(row)
        for t in open_:
            lo, hi, below, final = state[t]
            k = t[1]
            cum = below
            for cell in sorted(hist.get(ranges[(t[0], lo, hi, final)], []), key=lambda r: r["b"]):
                if k < cum + cell["n"]:
                    if final or cell["lo"] == cell["hi"]:
                        done[t] = float(cell["lo"])
                    else:
                        state[t] = (float(cell["lo"]), float(cell["hi"]), cum, cell["n"] <= FINAL_RANGE_ROWS)
                    break
                cum += cell["n"]
            else:
                raise RuntimeError(f"rank {k} of {t[0]} not found in its search range")
    raise RuntimeError("quantile search did not converge")


def _percentile_jobs(cols: Sequence[str], n_rows: int) -> list[list[str]]:
    """Columns per job so their percentile maps hold at most PERCENTILE_BUDGET entries together."""
    per = max(1, min(AGG_CHUNK, PERCENTILE_BUDGET // max(n_rows, 1)))
    return [list(cols[i:i + per]) for i in range(0, len(cols), per)]


def _percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], n_rows: int) -> dict[str, list]:
    out: dict[str, list] = {}
    arr = F.array(*[F.lit(float(p)) for p in probs])
    for job in _percentile_jobs(list(cols), n_rows):
        res = df.agg(*[F.percentile(F.col(c), arr).alias(c) for c in job]).first().asDict()
        for c in job:
            out[c] = list(res[c]) if res[c] is not None else [None] * len(probs)
    return out


def column_stats_exprs(cols: Sequence[str]) -> list[Column]:
    """The pre-pass of ``exact_quantiles`` as expressions, to ride on another aggregate."""
    return [F.count(F.lit(1)).alias("__rows")] + [e for c in cols for e in (
        F.count(c).alias(f"n__{c}"), F.min(c).alias(f"mn__{c}"), F.max(c).alias(f"mx__{c}"))]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    max_percentile_rows: int | None = None, n_rows: int | None = None,
                    stats: dict | None = None) -> dict[str, list]:
    """{col: [q(p) for p in probs]} over non-null values; None for an all-null column.

    Inputs of at most ``max_percentile_rows`` rows use Spark's exact ``percentile``; larger ones the
    batched rank search (``kth_smallest``). Both give the same answer (tested). ``stats``: the
    values of ``column_stats_exprs(cols)`` when an earlier aggregate already computed them.
    """
    cols = list(cols)
    if not cols:
        return {}
    if max_percentile_rows is None:
        max_percentile_rows = PERCENTILE_MAX_ROWS
    if n_rows is not None and n_rows <= max_percentile_rows:
        return _percentiles(df, cols, probs, n_rows)
    have = stats is not None and "__rows" in stats and all(f"n__{c}" in stats for c in cols)
    pre = stats if have else wide_agg(df, column_stats_exprs(cols))
    if pre["__rows"] <= max_percentile_rows:
        return _percentiles(df, cols, probs, pre["__rows"])
    out: dict[str, list] = {}
    ranks: dict[str, list] = {}
    for c in cols:
        n = pre[f"n__{c}"]
        if n == 0:
            out[c] = [None] * len(probs)
            continue
        ranks[c] = []
        for p in probs:
            h = (n - 1) * p
            k0 = int(math.floor(h))
            ranks[c].append((h - k0, k0, min(k0 + 1, n - 1)))
    if ranks:
        targets = sorted({(c, k) for c, rs in ranks.items() for _, k0, k1 in rs for k in (k0, k1)})
        found = kth_smallest(df.select(*ranks), targets, {c: (pre[f"mn__{c}"], pre[f"mx__{c}"]) for c in ranks})
        for c, rs in ranks.items():
            out[c] = [found[(c, k0)] + frac * (found[(c, k1)] - found[(c, k0)]) for frac, k0, k1 in rs]
    return out
