"""Embedding whitening against floating-point eigenvectors and exact brute force."""

import math
import random

import numpy as np
import pytest

from tabml.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<double>, id string, n int, w string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "w", "c") for i, v in rows], SCHEMA)


def scatter(x):
    return [[int(v) for v in row] for row in len(x) * x.T.dot(x) - np.outer(x.sum(0), x.sum(0))]


def check(got, rows, parts):
    """Every column against brute force over the integers of ``rows``."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(float) / n
    cov = y.T @ y / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert len(got) == n * parts
    want = [(i, sum(int(n * a - b) ** 2 for a, b in zip(v, s))) for (i, _), v in zip(rows, x)]
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == sorted(want, key=str)
    white = np.zeros((n, parts))
    order = {}
    for r in got:
        order.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained
    for i, (vid, v) in enumerate(zip([r[0] for r in rows], x)):
        key = (vid, sum(int(n * a - b) ** 2 for a, b in zip(v, s)))
        white[i] = [order[key][k + 1].pop() for k in range(parts)]
    white -= white.mean(0)
    assert np.allclose(white.T @ white / n, np.eye(parts), atol=1e-9)
    # the components span the leading directions: cov restricted to them is diagonal with the leading values
    basis = np.linalg.lstsq(white, y, rcond=None)[0]  # rows: sqrt(e) * vector
    unit = basis / np.linalg.norm(basis, axis=1, keepdims=True)
    assert np.allclose(unit @ cov @ unit.T, np.diag(values[:parts]), atol=1e-6 * values[0])


def test_against_floating_point(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    rows = [(i, [float(c) for c in rng.normal(size=12) @ mix * 0.1]) for i in range(90)]
    rows += [rows[4], rows[4], (None, rows[7][1])]  # repeated rows and a null id take part
    got = whitening.whiten(frame(spark, rows).repartition(5)).withColumnRenamed("id", "vec_id")
    check(got.collect(), rows, 8)


def test_left_out_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [0.75, 0.5])]
    bad = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, []), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(frame(spark, good + bad)).withColumnRenamed("id", "vec_id").collect()
    check(got, good, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None), (2, [])]])
def test_no_variance(spark, rows):
    got = whitening.whiten(frame(spark, rows))
    assert got.collect() == [] and got.columns[:4] == ["id", "component", "n", "deviation"]


def test_equal_eigenvalues_and_low_rank(spark):
    rows = [(i, [float(s) if j == k else 0.0 for j in range(5)]) for i, (k, s) in enumerate((k, s) for k in range(4) for s in (-1, 1))]
    got = whitening.whiten(frame(spark, rows)).withColumnRenamed("id", "vec_id").collect()  # four equal roots, one of value 0
    check(got, rows, 4)


def test_wide_entries_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e9, 1e9) for _ in range(3)]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).withColumnRenamed("id", "vec_id").collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((20 * a - b) ** 2 for a, b in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)
    y = np.array([[-(1 << 40), 5, 1 << 49], [70_000, -1, 3]], dtype=np.int64)
    assert (whitening.exact_products(y) == y.astype(object).T.dot(y.astype(object))).all()


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, size=(30, 5)).astype(object)
    m = scatter(x)
    # Faddeev-LeVerrier in integers
    a, poly, b = np.array(m, dtype=object), [1], np.eye(5, dtype=object) * 0 + np.eye(5, dtype=int).astype(object)
    for k in range(1, 6):
        ab = a.dot(b)
        c = -sum(ab[i, i] for i in range(5)) // k
        poly.append(int(c))
        b = ab + c * np.eye(5, dtype=int).astype(object)
    assert eigen.characteristic_polynomial(spark, m) == poly[::-1]
    roots = np.sort(np.linalg.eigvalsh(np.array(m, dtype=float)))[::-1]
    assert [eigen.roots_above(poly[::-1], int(r) + 1) for r in roots] == [0, 1, 2, 3, 4]
    assert eigen.isolate([-8, 12, -6, 1], 2, 6)[1:] == (1, 3) and eigen.isolate([-8, 12, -6, 1], 2, 6)[0] == 2 << eigen.FRACTION
    p = eigen.primes_below(1 << 10, 3)
    assert p == [1021, 1019, 1013]
    zero = [[0, 0, 3], [0, 0, 0], [3, 0, 0]]  # a zero pivot in the reduction
    assert eigen.hessenberg_polynomial(np.array(zero), 1021).tolist() == [0, 1021 - 9, 0, 1]
