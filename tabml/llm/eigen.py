"""Leading eigenpairs of an integer scatter matrix, from its exact characteristic polynomial.

The matrix (symmetric, no negative eigenvalue) has a side of the vectors' length, whatever the number of rows; only it and its
polynomial pass the driver.

1. The polynomial modulo one prime: reduction to Hessenberg form by similarity, then the recurrence over leading minors. Primes are
   independent, so they are rows of a Spark table.
2. Chinese remaindering per coefficient, with enough primes to pass twice the largest coefficient (Maclaurin's bound by the trace).
3. All roots are real, so the sign changes of p(x + a) count the roots above a exactly, multiple ones by multiplicity. Bisection by that
   count isolates a root; the sign of p then halves its interval to 2**-FRACTION.
4. Inverse iteration on matrix - root in DIGITS decimal digits spans the null space: one vector for a simple root, for a root of
   multiplicity m an orthonormal basis of m.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bits after the point of an isolated root, and decimal digits of the inverse iteration.
FRACTION = 160
DIGITS = 140


def primes_below(top: int, many: int) -> list[int]:
    """The ``many`` largest primes under ``top`` (at most 2**32), by strong pseudoprime tests that are exact there."""
    out, n = [], top - 1 if top % 2 == 0 else top - 2
    while len(out) < many:
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        if all(n % b == 0 or pow(b, d, n) in (1, n - 1) or any(pow(b, d << r, n) == n - 1 for r in range(1, s)) for b in (2, 7, 61)):
            out.append(n)
        n -= 2
    return out


def primes_needed(matrix: list[list[int]]) -> list[int]:
    """Primes whose product passes twice every coefficient: e_k <= C(d, k) (trace / d)**k."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    share = -(-trace // d) if d else 0
    most = max(math.comb(d, k) * share**k for k in range(d + 1))
    many = (2 * most + 1).bit_length() // 30 + 2
    return primes_below(1 << 31, many)


def hessenberg_polynomial(h: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - h) modulo the prime p; h has entries in [0, p)."""
    h, d = h.astype(np.int64).copy(), len(h)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        r = j + 1 + int(below[0])
        if r != j + 1:
            h[[r, j + 1]] = h[[j + 1, r]]
            h[:, [r, j + 1]] = h[:, [j + 1, r]]
        factor = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - factor[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * factor % p).sum(1)) % p
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: of the leading k x k block
    poly[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, dtype=np.int64)
        row[1:] = poly[k - 1, :-1]
        times, run = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):  # entry (i, k - 1) times the product of the subdiagonal below it
            times[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else run
        poly[k] = (row - (times[:, None] * poly[:k] % p).sum(0)) % p
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients (constant first) of det(x - matrix)."""
    primes = primes_needed(matrix)
    shared = spark.sparkContext.broadcast((matrix, primes))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ps = shared.value
        whole = np.array(whole, dtype=object)
        for b in batches:
            for i in b.column("id").to_pylist():
                got = hessenberg_polynomial((whole % ps[i]).astype(np.int64), ps[i])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), pa.array([i] * len(got), pa.int32()),
                                                  pa.array(got)], ["power", "prime", "residue"])

    def remainder(table: pa.Table) -> pa.Table:
        ps = shared.value[1]
        value, modulus = 0, 1
        for i, r in sorted(zip(table.column("prime").to_pylist(), table.column("residue").to_pylist())):
            value += modulus * ((r - value) * pow(modulus, -1, ps[i]) % ps[i])
            modulus *= ps[i]
        value = value - modulus if 2 * value > modulus else value
        return pa.table({"power": table.column("power")[:1], "coefficient": pa.array([str(value)], pa.string())})

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(residues, "power int, prime int, residue long")
    got = rows.groupBy("power").applyInArrow(remainder, "power int, coefficient string").collect()  # one row a power
    out = [0] * (len(matrix) + 1)
    for r in got:
        out[r["power"]] = int(r["coefficient"])
    return out


def roots_above(poly: list[int], a: int) -> int:
    """Roots of a polynomial with real roots only that are greater than a, with multiplicity: sign changes of p(x + a)."""
    c = list(poly)
    n = len(c) - 1
    for i in range(n if a else 0):
        for j in range(n - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int, top: int) -> tuple[int, int, int]:
    """(numerator of the k-th largest root over 2**FRACTION, first and last rank of roots equal to it at that width)."""
    n = len(poly) - 1
    scaled = [c << (FRACTION * (n - i)) for i, c in enumerate(poly)]

    def sign(a: int) -> int:
        v = 0
        for c in reversed(scaled):
            v = v * a + c
        return (v > 0) - (v < 0)

    lo, hi = 0, (top + 1) << FRACTION
    many_lo, many_hi = roots_above(scaled, lo), 0
    while hi - lo > 1 and many_lo - many_hi > 1:
        mid = (lo + hi) // 2
        many = roots_above(scaled, mid)
        if many >= k:
            lo, many_lo = mid, many
        else:
            hi, many_hi = mid, many
    if many_lo - many_hi == 1:  # one simple root in (lo, hi]
        at_hi = sign(hi)
        if at_hi == 0:
            return hi, k, k
        while hi - lo > 1:
            mid = (lo + hi) // 2
            s = sign(mid)
            if s == 0:
                return mid, k, k
            lo, hi = (lo, mid) if s == at_hi else (mid, hi)
    return hi, many_hi + 1, many_lo


def null_space(matrix: list[list[int]], root: int, many: int) -> list[list[Decimal]]:
    """Orthonormal vectors next to the null space of matrix - root / 2**FRACTION, by inverse iteration on a fixed start."""
    d = len(matrix)
    with decimal.localcontext() as ctx:
        ctx.prec = DIGITS + len(str(root))
        shift = Decimal(root) / Decimal(1 << FRACTION)
        a = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object)
        a[np.arange(d), np.arange(d)] -= shift
        size = max([abs(x) for x in a.ravel()] + [Decimal(1)])
        tiny = size * Decimal(10) ** -ctx.prec
        order = list(range(d))
        for j in range(d):
            r = max(range(j, d), key=lambda i: abs(a[i, j]))
            if r != j:
                a[[r, j]] = a[[j, r]]
                order[r], order[j] = order[j], order[r]
            if abs(a[j, j]) < tiny:
                a[j, j] = tiny
            if j + 1 < d:
                a[j + 1:, j] = a[j + 1:, j] / a[j, j]
                a[j + 1:, j + 1:] = a[j + 1:, j + 1:] - np.multiply.outer(a[j + 1:, j], a[j, j + 1:])

        def solve(b: np.ndarray) -> np.ndarray:
            x = b[order].copy()
            for j in range(1, d):
                x[j] = x[j] - np.dot(a[j, :j], x[:j])
            for j in range(d - 1, -1, -1):
                x[j] = ((x[j] - np.dot(a[j, j + 1:], x[j + 1:])) if j + 1 < d else x[j]) / a[j, j]
            return x

        def orthonormal(rows: list[np.ndarray]) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            for v in rows:
                v = v / max(abs(x) for x in v)
                for _ in range(2):
                    for u in out:
                        v = v - u * np.dot(u, v)
                out.append(v / np.dot(v, v).sqrt())
            return out

        span = orthonormal([np.array([Decimal(1 + (i * 7919 + (j + 1) * (i + 3) * 104729) % 1009) for i in range(d)], dtype=object)
                            for j in range(many)])
        small = Decimal(10) ** -40
        for _ in range(12):
            new = orthonormal([solve(v) for v in span])
            # at rest when every old vector lies in the new span
            off = max(max(abs(x) for x in v - sum(u * np.dot(u, v) for u in new)) for v in span)
            span = new
            if off < small:
                break
        return [list(v) for v in span]


def leading_pairs(spark: SparkSession, matrix: list[list[int]], parts: int) -> list[tuple[float, float, list[float]]]:
    """(root, share of the trace, unit vector) of up to ``parts`` largest positive roots, largest first."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return []
    poly = characteristic_polynomial(spark, matrix)
    many = min(parts, roots_above(poly, 0))
    shared = spark.sparkContext.broadcast((matrix, poly, trace))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p, total = shared.value
        for b in batches:
            for k in b.column("id").to_pylist():
                root, first, last = isolate(p, k, total)
                v = null_space(m, root, last - first + 1)[k - first]
                lead = max(v, key=abs)
                v = [float(-x if lead < 0 else x) for x in v]
                with decimal.localcontext() as ctx:
                    ctx.prec = DIGITS + len(str(root))
                    value = Decimal(root) / Decimal(1 << FRACTION)
                    row = (k, float(value), float(value / Decimal(total)), v)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["component", "root", "share", "vector"])

    rows = spark.range(1, many + 1, 1, many).mapInArrow(pairs, "component long, root double, share double, vector array<double>")
    return [(r["root"], r["share"], list(r["vector"])) for r in sorted(rows.collect(), key=lambda r: r["component"])]
