"""Embedding whitening by principal components that come from exact integers.

Entries become integers, so counts, sums and products are summed exactly in any order: tasks add up 16-bit limbs by matrix products
that a double holds exactly, Spark adds the tasks' sums as decimals. The scatter n * sum(x x') - S S' is n**2 times the covariance;
its leading eigenpairs come from ``tabml.llm.eigen``.

Nulls and odd rows: a row whose vector is null, empty, or holds a null or a non-finite entry is dropped, as is one whose length is not
the most frequent one (of equally frequent ones the largest counts), since it has no covariance with the rest. A null id is kept;
repeated rows count each. Entries beyond 2**40 are held to it. Without variance (one row, equal rows) or without rows there are no
components and so no result rows; components of eigenvalue 0 are left out. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.llm.eigen import leading_pairs
from tabml.llm.store import Scratch

#: Fixed values of the integer form: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = 2.0**40
RESULT = "id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def clean_rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(rows (id, v array<double>) that take part, length of their vectors; 0 without rows)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first["d"] if first else 0
    return rows.where(F.size("v") == d), d


def integers(column: pa.Array, d: int) -> np.ndarray:
    """x - OFFSET of a list column's rows, (rows, d)."""
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as sum of limbs times 2**(16 k), all but the last in [0, 2**16), the last signed and as small."""
    out = []
    while len(y) and (y.max() >= 1 << 15 or y.min() < -(1 << 15)):
        out.append((y & 0xFFFF).astype(np.float64))
        y = y >> 16
    return [*out, y.astype(np.float64)]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers; sums of at most 2**20 limb products stay under 2**53."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a in range(0, len(y), 1 << 20):
        parts = limbs(y[a: a + (1 << 20)])
        for i, x in enumerate(parts):
            for j, z in enumerate(parts):
                total += (x.T @ z).astype(np.int64).astype(object) * (1 << 16 * (i + j))
    return total


def moments(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, scatter) of the rows' integers, less OFFSET; the scatter is n * sum(y y') - S S'."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for b in batches:
            y = integers(b.column("v"), d)
            n += len(y)
            sums += y.astype(object).sum(0) if len(y) else 0
            products += exact_products(y)
        if n:
            i, j = np.triu_indices(d)
            a = np.r_[[-1], np.full(d, -1), i].astype(np.int32)
            c = np.r_[[-1], np.arange(d), j].astype(np.int32)
            v = [Decimal(int(x)) for x in [n, *sums, *products[i, j]]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(v, pa.decimal128(38, 0))], ["i", "j", "v"])

    # one row for each entry of a d x d table: bounded by the vectors' length, not by the rows
    got = rows.select("v").mapInArrow(partial, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    at = {(r["i"], r["j"]): int(r["v"]) for r in got}
    n, s = at.get((-1, -1), 0), [at.get((-1, j), 0) for j in range(d)]
    return n, s, [[n * at.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: see ``RESULT``. ``deviation`` is null where it passes 64 bits; its digits are always in
    ``deviation_exact``."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows, d = clean_rows(vectors, id_col, vector_col)
    n, sums, scatter = moments(rows, d) if d else (0, [], [])
    pairs = leading_pairs(spark, scatter, parts) if n else []
    if not pairs:
        return spark.createDataFrame([], RESULT.format(id=kind))
    shared = spark.sparkContext.broadcast((sums, np.array([v for _, _, v in pairs]).T, np.sqrt([root for root, _, _ in pairs])))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, basis, size = shared.value
        for b in batches:
            y = integers(b.column("v"), d)
            far = n * int(np.abs(y).max(initial=0)) + max(abs(x) for x in s)
            off = n * y - np.array(s) if far < 1 << 62 else n * y.astype(object) - np.array(s, dtype=object)
            square = (off * off if far * far * d < 1 << 62 else off.astype(object) ** 2).sum(1).tolist()
            white = off.astype(np.float64) @ basis / size
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([x if x < 1 << 63 else None for x in square], pa.int64()), pa.array(map(str, square), pa.string()),
                pa.ListArray.from_arrays(np.arange(0, white.size + 1, len(size), dtype=np.int32), pa.array(white.ravel()))], ["id", "deviation", "deviation_exact", "w"])

    wide = rows.mapInArrow(project, f"id {kind}, deviation long, deviation_exact string, w array<double>")
    wide = Scratch(spark, "whitening").table(wide)
    k = len(pairs)
    pairs_of = [(i, j) for i in range(k) for j in range(i, k)]
    off = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - F.lit(float(i == j))) for i, j in pairs_of]
    error = wide.select(F.greatest(*off) if len(off) > 1 else off[0]).first()[0]  # one value
    shares = F.array(*[F.lit(share) for _, share, _ in pairs])
    out = wide.select("id", "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    return out.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")
