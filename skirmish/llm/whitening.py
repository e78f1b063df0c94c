"""Embedding whitening through the exact characteristic polynomial of the scatter.

1. Scatter. Vectors become whole numbers; Spark sums them, and then their products
   centred at the rounded means, in whole numbers of any size. n times the products'
   sums less the products of the sums is n^2 times the covariance: a matrix of whole
   numbers M, as large as a vector is wide, whatever the number of rows.
2. Polynomial. For each of as many 31-bit primes as a bound on the coefficients asks
   for, a task brings M to Hessenberg form modulo the prime and expands its
   characteristic polynomial; Chinese remaindering joins the residues.
3. Roots. All roots are real, so the sign changes of the polynomial shifted to a count
   the roots above a exactly (Descartes). Halving isolates the largest roots, and signs
   refine them on a grid of 2^-bits; roots that no grid of ``CLOSE`` bits below their
   size tells apart are one cluster.
4. Components. A task for each cluster solves (M - root) v = start twice in decimals of
   many digits (inverse iteration on the null space), with as many starts as the cluster
   has roots, each made orthogonal to those before. Residuals are checked.
5. Whitening. Centred vectors are projected on the components over the roots of the
   eigenvalues; their covariance is measured on the written rows.

Defined results: see :mod:`skirmish.llm.vectors` for the vectors that take part. A
component without variance is left out, so equal vectors, one vector and an empty
table give no rows. Components of equal eigenvalues are any orthonormal ones, the same
for all rows; an entry largest in size is positive. Ids may be null or repeat; a
deviation beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import giving_back, materialize
from .vectors import ROWS, exact_sums, halves, matrix, rows_at_a_time, spans, whole

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Bits below its own size at which a root is told from its neighbours.
CLOSE = 160
_LONG = 1 << 63


def _parts(batches: Iterator[pa.RecordBatch], width: int, centre: np.ndarray) -> Iterator[np.ndarray]:
    """Centred rows, in numbers in which the products of a batch are exact: doubles, longs or Python's."""
    for batch in rows_at_a_time(batches, ROWS):
        rows = matrix(batch.column(2), width).astype(object) - centre if centre.dtype == object else matrix(batch.column(2), width) - centre
        top = int(abs(rows).max(initial=0))
        yield rows.astype(np.float64) if top * top * ROWS < 1 << 53 else rows.astype(spans(top * top * ROWS))


def sums(vectors: DataFrame, width: int) -> list[int]:
    """The exact sum of every component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in rows_at_a_time(batches, ROWS):
            rows = matrix(batch.column(2), width)
            total += rows.astype(spans(int(abs(rows.astype(np.float64)).max(initial=0)) * 2 * ROWS)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *halves(total)], names=["i", "high", "low"])

    found = exact_sums(vectors.mapInArrow(lambda b: giving_back(add(b)), "i int, high long, low long"), "i")
    return [found[(i,)] for i in range(width)]


def scatter(vectors: DataFrame, width: int, n: int, total: list[int]) -> list[list[int]]:
    """n^2 x covariance, in whole numbers. Rows are centred at the rounded means before they are multiplied."""
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre = np.array(middle, spans(2 * max(abs(c) for c in middle)))
    at, to = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((width, width), object)
        for rows in _parts(batches, width, centre):
            found = rows.T @ rows
            products += np.rint(found).astype(np.int64).astype(object) if found.dtype == np.float64 else found.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(to, pa.int32()), *halves(products[at, to])], names=["i", "j", "high", "low"])

    found = exact_sums(vectors.mapInArrow(lambda b: giving_back(add(b)), "i int, j int, high long, low long"), "i", "j")
    left = [s - n * c for s, c in zip(total, middle, strict=True)]
    return [[n * found[min(i, j), max(i, j)] - left[i] * left[j] for j in range(width)] for i in range(width)]


def _is_prime(n: int) -> bool:
    """For odd n below 2^32: Miller and Rabin's test, certain for these bases."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product is above ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg(m: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``m`` modulo ``p`` with zeros below the subdiagonal."""
    h = m.copy()
    d = len(h)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1 :, c])
        if not len(below):
            continue
        at, k = c + 1, c + 1 + below[0]
        h[[at, k]] = h[[k, at]]
        h[:, [at, k]] = h[:, [k, at]]
        factor = h[at + 1 :, c] * pow(int(h[at, c]), -1, p) % p
        h[at + 1 :] = (h[at + 1 :] - factor[:, None] * h[at] % p) % p
        h[:, at] = (h[:, at] + (h[:, at + 1 :] * factor % p).sum(axis=1)) % p
    return h


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - m) modulo ``p``, the lowest power first."""
    h = hessenberg(m, p)
    d = len(h)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    chain = np.zeros(0, np.int64)  # products of the subdiagonal from each earlier row to this one
    for k in range(d):
        minors[k + 1, 1:] = minors[k, :-1]
        if k:
            chain = np.append(chain * h[k, k - 1] % p, h[k, k - 1])
        weights = np.append(h[:k, k] * chain % p, h[k, k])
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % p).sum(axis=0)) % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - M), the highest power first, for a symmetric M without negative eigenvalues.

    The kth is (-1)^k times a sum of products of k eigenvalues, which is at most what equal eigenvalues give.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    used = primes(max(comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_mod(np.array([[x % p for x in row] for row in m], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([found], pa.list_(pa.int64()))], names=["p", "residues"])

    asked = spark.createDataFrame([(p,) for p in used], "p long").repartition(min(len(used), 4 * spark.sparkContext.defaultParallelism))
    residues = {r["p"]: r["residues"] for r in asked.mapInArrow(reduce, "p long, residues array<bigint>").collect()}
    out, product = [0] * (d + 1), 1
    for p in used:
        inverse = pow(product, -1, p)
        signed = [r if (d - i) % 2 == 0 else -r for i, r in enumerate(residues[p])]
        out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, signed, strict=True)]
        product *= p
    return [-c if (d - i) % 2 else c for i, c in enumerate(out)][::-1]


def _above(poly: list[int], a: int) -> int:
    """The number of roots above ``a``, each as often as it counts: sign changes of the polynomial shifted to ``a``."""
    c = list(poly)
    for stop in range(len(c), 1, -1):
        for i in range(1, stop):
            c[i] += a * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], a: int) -> int:
    out = 0
    for c in poly:
        out = out * a + c
    return out


def largest_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """(root, bits, count), the larger first: root / 2^bits lies within one grid step of ``count`` roots.

    Clusters cover the ``wanted`` largest positive roots, or all of them if fewer.
    """
    while len(poly) > 1 and poly[-1] == 0:
        poly = poly[:-1]
    out: list[tuple[int, int, int]] = []
    have, bits = 0, CLOSE
    while have < min(wanted, len(poly) - 1):
        grid = [c << (bits * k) for k, c in enumerate(poly)]
        low, high = 0, (-poly[1] + 1) << bits  # the roots' sum is above each
        count_low, count_high = len(poly) - 1, 0
        while high - low > max(1, high >> CLOSE):
            if count_low - have == 1 and count_high == have:
                break
            middle = (low + high) // 2
            n = _above(grid, middle)
            low, high, count_low, count_high = (middle, high, n, count_high) if n > have else (low, middle, count_low, n)
        if count_low - have == 1:
            side = -1 if have % 2 else 1  # the polynomial's sign between this root and the one above
            while high - low > max(1, high >> CLOSE):
                middle = (low + high) // 2
                low, high = (low, middle) if _value(grid, middle) * side >= 0 else (middle, high)
        if high.bit_length() < CLOSE // 2:  # the grid is too wide for so small a root
            bits *= 2
            continue
        out.append((high, bits, count_low - have))
        have = count_low
    return out


def _solve(lu: list[list[Decimal]], swaps: list[int], b: list[Decimal]) -> list[Decimal]:
    x = [b[i] for i in swaps]
    d = len(x)
    for i in range(d):
        for k in range(i):
            x[i] -= lu[i][k] * x[k]
    for i in reversed(range(d)):
        for k in range(i + 1, d):
            x[i] -= lu[i][k] * x[k]
        x[i] /= lu[i][i]
    return x


def _factored(a: list[list[Decimal]], least: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """Triangular factors in place, with row swaps; a pivot of zero becomes ``least``."""
    d, swaps = len(a), list(range(len(a)))
    for c in range(d):
        at = max(range(c, d), key=lambda i: abs(a[i][c]))
        a[c], a[at], swaps[c], swaps[at] = a[at], a[c], swaps[at], swaps[c]
        if abs(a[c][c]) < least:
            a[c][c] = least
        for i in range(c + 1, d):
            if a[i][c]:
                f = a[i][c] = a[i][c] / a[c][c]
                row, by = a[i], a[c]
                for k in range(c + 1, d):
                    row[k] -= f * by[k]
    return a, swaps


def eigenvectors(m: list[list[int]], root: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the cluster of roots at root / 2^bits."""
    d = len(m)
    largest = max(abs(x) for row in m for x in row)
    with localcontext(Context(prec=60 + (CLOSE + largest.bit_length() + bits) // 3)):
        at = Decimal(root) / Decimal(1 << bits)
        lu, swaps = _factored([[Decimal(x) - (at if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(m)], Decimal(largest) / Decimal(1 << (2 * CLOSE)))
        found: list[list[Decimal]] = []
        seed = 1
        while len(found) < count:
            v = []
            for _ in range(d):
                seed = seed * 48271 % 2147483647  # a fixed start, in no special place
                v.append(Decimal(seed))
            for _ in range(2):
                v = _solve(lu, swaps, v)
                for u in found:
                    dot = sum(x * y for x, y in zip(u, v, strict=True))
                    v = [y - dot * x for x, y in zip(u, v, strict=True)]
                size = sum(x * x for x in v).sqrt()
                v = [x / size for x in v]
            residual = max(abs(sum(x * y for x, y in zip(row, v, strict=True)) - at * v[i]) for i, row in enumerate(m))
            if residual > at / 10**25:
                raise ArithmeticError("a component misses its eigenvalue")
            top = max(v, key=abs)
            found.append([-x for x in v] if top < 0 else v)
        return [[float(x) for x in v] for v in found]


def components(spark: SparkSession, m: list[list[int]], wanted: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit vector) of the ``wanted`` largest positive eigenvalues of M, the larger first."""
    if not any(m[i][i] for i in range(len(m))):
        return []
    clusters = largest_roots(characteristic_polynomial(spark, m), wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([eigenvectors(m, *clusters[k])], pa.list_(pa.list_(pa.float64())))], names=["k", "vectors"])

    asked = spark.range(0, len(clusters), 1, len(clusters)).select(F.col("id").alias("k"))
    found = {r["k"]: r["vectors"] for r in asked.mapInArrow(find, "k long, vectors array<array<double>>").collect()}
    return [(Fraction(root, 1 << bits), v) for k, (root, bits, _) in enumerate(clusters) for v in found[k]][:wanted]


def project(vectors: DataFrame, width: int, n: int, total: list[int], directions: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): the exact squared distance from the mean times n^2, and the centred vector times ``directions``."""
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre = np.array(middle, spans(2 * max(abs(c) for c in middle)))
    left = np.array([s - n * c for s, c in zip(total, middle, strict=True)], object)
    rest = np.array([float(Fraction(int(x), n)) for x in left])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, ROWS):
            rows = matrix(batch.column(2), width).astype(centre.dtype) - centre
            top = n * int(abs(rows).max(initial=0)) + int(abs(left).max())
            kind = spans(width * top * top)
            apart = rows.astype(kind) * kind(n) - left.astype(kind) if kind is np.int64 else rows.astype(object) * n - left
            far = (apart * apart).sum(axis=1)
            w = (rows.astype(np.float64) - rest) @ directions
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([int(x) if x < _LONG else None for x in far], pa.int64()), pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())],
                names=["vec_id", "deviation", "w"],
            )

    return vectors.mapInArrow(lambda b: giving_back(apply(b)), "vec_id long, deviation long, w array<double>")


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """The largest entry, in size, of the covariance of ``w`` less the identity; rows are centred at their mean before they are multiplied."""
    mean = rows.agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k))).first()
    apart = [F.col("w")[i] - F.lit(mean[i] / n) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*(F.sum(apart[i] * apart[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"p{i}_{j}"] / n - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, wanted: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error); see the query's contract."""
    spark = df.sparkSession
    vectors = whole(df, scale)
    vectors = vectors.withColumn("v", F.transform("v", lambda x: x + F.lit(offset)))
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    found: list[tuple[Fraction, list[float]]] = []
    if n and width:
        total = sums(vectors, width)
        m = scatter(vectors, width, n, total)
        found = components(spark, m, wanted)
    if not found:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    trace = sum(m[i][i] for i in range(width))
    # whitened = (x - S/n) v / sqrt(root / n^2)
    directions = np.array([v for _, v in found]).T * np.array([float(n) / _root(e) for e, _ in found])
    rows = materialize(project(vectors, width, n, total, directions), "whitened")
    error = identity_error(rows, n, len(found))
    shares = F.array(*(F.lit(float(e / trace)) for e, _ in found))
    spread = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return spread.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def _root(x: Fraction) -> float:
    """Square root of a positive fraction of any size, to double precision."""
    shift = max(0, 128 - x.numerator.bit_length() + x.denominator.bit_length())
    shift += shift % 2
    return float(Fraction(isqrt((x.numerator << shift) // x.denominator), 1 << (shift // 2)))
