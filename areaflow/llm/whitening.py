"""Principal components and whitening of integer-scaled embeddings, from an exact characteristic polynomial.

Vectors become integers (``floor(scale * entry)``). Over the distinct ones (the fit list, ``n`` vectors with sums ``S``) the matrix
``M = n * sum(x x') - S S'`` is ``n * n`` times their covariance, in integers. Its characteristic polynomial is
taken modulo many primes by reduction to Hessenberg form, one Spark task for some primes each, and put together by
Chinese remaindering; enough primes are used that the integer coefficients are certain. All roots are real, so the sign
changes of the polynomial's Taylor shift count the roots above any point exactly: bisection encloses the
greatest roots as closely as wanted, however near to each other they lie. Each component is then the null vector of ``M - root``,
by inverse iteration in long decimals.

What the driver gets follows the dimension, not the rows: ``d * (d + 1) / 2`` sums, a residue for each coefficient and prime.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, as are rows whose vector
has another length than most have (ties: the longer; empty vectors are no vectors). Entries beyond the range of 64 bits are held at its ends.
Repeated rows and null ids give their own results; repeated vectors count once in the fit. Components
with eigenvalue 0 cannot be whitened and are not returned, so an empty table or a single distinct vector gives no rows. For an
eigenvalue that occurs more than once, any orthonormal basis of its space. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import batches, map_arrow, staged

#: Bits of a limb of an exact sum.
LIMB = 40
#: Relative width of the interval that encloses a root, as a power of two.
ROOT_BITS = 200
#: Decimal digits of the inverse iteration.
DIGITS = 160
#: Primes of one task.
PRIMES = 8


# --- exact sums ------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of every row with a whole, finite vector of the usual length."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    finite = F.forall("embedding", lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    sound = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    usual = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    # One number; a scalar subquery of the same scan.
    d = usual.select("d").scalar()
    return sound.filter(F.size("embedding") == d).select(F.col("vec_id"), x.alias("x"))


def _greatest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _products(a: np.ndarray) -> np.ndarray:
    """``a.T @ a`` in integers: by doubles while no partial sum can leave 53 bits, else by Python's integers."""
    if _greatest(a) ** 2 * len(a) < 2 ** 53:
        return (a.astype(float).T @ a.astype(float)).astype(np.int64).astype(object)
    return a.astype(object).T @ a.astype(object)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    values = batch[column].flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(batch), -1)


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of the vectors ``x``, exactly, as sums over tasks of limbs."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            if not len(batch):
                continue
            x = _matrix(batch)
            for k in range(0, len(x), 4096):
                ones = np.hstack([np.ones((len(x[k:k + 4096]), 1), np.int64), x[k:k + 4096]])
                part = _products(ones)
                total = part if total is None else total + part
        rows = []
        if total is not None:
            for i in range(len(total)):
                for j in range(i, len(total)):
                    value, limb = int(total[i, j]), 0
                    while value not in (0, -1) or limb == 0:
                        rows.append((i, j, limb, value & ((1 << LIMB) - 1)))
                        value >>= LIMB
                        limb += 1
                    if value:
                        rows.append((i, j, limb, value))
        names = ("i", "j", "limb", "value")
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, types, strict=True)], names)

    batches(fit.sparkSession)
    sums = fit.select("x").mapInArrow(run, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], int] = {}
    for r in sums.collect():  # bounded by the dimension
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (r.value << LIMB * r.limb)
    d = max((i for i, _ in found), default=0)
    at = lambda i, j: found.get((min(i, j), max(i, j)), 0)
    return at(0, 0), [at(0, j) for j in range(1, d + 1)], [[at(i, j) for j in range(1, d + 1)] for i in range(1, d + 1)]


# --- characteristic polynomial -----------------------------------------------------

def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo the prime ``p`` with zeros below the first subdiagonal."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        times = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - times[:, None] * h[k + 1] % p) % p
        back = np.zeros(d, np.int64)
        for column, t in enumerate(times, k + 2):  # products below p * p < 2**62 are reduced one by one
            back = (back + h[:, column] * t) % p
        h[:, k + 1] = (h[:, k + 1] + back) % p
    return h


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of ``det(z - a)`` modulo ``p``, from the constant up."""
    h, d = hessenberg(a, p), len(a)
    polys = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - int(h[k, k]) * polys[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            factor = chain * int(h[i, k]) % p
            if factor:
                new[:i + 1] = (new[:i + 1] - factor * polys[i]) % p
        polys.append(new)
    return polys[d].tolist()


def _is_prime(n: int) -> bool:
    """Miller-Rabin; the bases 2, 3, 5 and 7 decide every number below 3.2e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The greatest primes below 2**31 whose product has more than ``bits`` bits."""
    out, product, n = [], 1, 2 ** 31 - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of ``det(z - m)`` of a symmetric matrix without negative eigenvalues, from the constant up.

    The k-th coefficient is a sum of ``comb(d, k)`` products of k eigenvalues, at most ``comb(d, k) * (trace / d)**k`` in size.
    """
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    mean = trace // d + 1
    most = max(comb(d, k) * mean ** k for k in range(d + 1))
    chosen = primes(most.bit_length() + 2)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            found = [polynomial_modulo(np.array([[v % p for v in row] for row in m], np.int64), p) for p in batch["p"].tolist()]
            yield pd.DataFrame({"p": batch["p"], "residues": found})

    todo = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(-(-len(chosen) // PRIMES), "p")
    rows = todo.mapInPandas(run, "p long, residues array<long>").collect()
    product = 1
    for r in rows:
        product *= r.p
    weights = [(product // r.p) * pow(product // r.p, -1, r.p) for r in rows]
    out = []
    for k in range(d + 1):
        c = sum(w * r.residues[k] for w, r in zip(weights, rows, strict=True)) % product
        out.append(c - product if c > product // 2 else c)
    return out


# --- roots ---------------------------------------------------------------------------

def roots_above(poly: list[int], a: int) -> int:
    """How many roots, counted as often as they occur, exceed ``a``: sign changes of ``poly(z + a)``, exact for real roots."""
    c, d = list(poly), len(poly) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def greatest_roots(poly: list[int], many: int, bound: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The ``many`` greatest positive roots of a polynomial with real roots from 0 to ``bound``, as ``(k, e)``: near ``k / 2**e``.

    Roots are enclosed to a relative width of ``2**-bits``. Intervals are halved until each holds one
    root; then the polynomial's sign there decides, so the costly counts are few.
    """
    d = len(poly) - 1
    scaled: dict[int, list[int]] = {}

    def at(e: int) -> list[int]:
        """The polynomial whose roots are ``2**e`` times as large."""
        if e not in scaled:
            scaled.clear()
            scaled[e] = [c << e * (d - k) for k, c in enumerate(poly)]
        return scaled[e]

    def value(k: int, e: int) -> int:
        out = 0
        for c in reversed(at(e)):
            out = out * k + c
        return (out > 0) - (out < 0)

    positive = roots_above(poly, 0)
    out = []
    for rank in range(1, min(many, positive) + 1):
        low, high, e = 0, bound + 1, 0  # the root lies in (low, high] / 2**e
        above_low, above_high = positive, 0
        while high.bit_length() - (high - low).bit_length() < bits:
            if high - low == 1:
                low, high, e = low << 1, high << 1, e + 1
            mid = (low + high) >> 1
            if above_low - above_high > 1:
                n = roots_above(at(e), mid)
                if n >= rank:
                    low, above_low = mid, n
                else:
                    high, above_high = mid, n
            else:
                # One root in (low, high], above_high above: beyond it the sign is that of (-1)**above_high.
                s = value(mid, e)
                if s == (1 if above_high % 2 == 0 else -1) or s == 0:
                    high = mid
                else:
                    low = mid
        out.append((low + high, e + 1))
    return out


# --- components -------------------------------------------------------------------------

def null_vectors(m: list[list[int]], root: Decimal, many: int, seed: int = 1) -> list[list[Decimal]]:
    """``many`` orthonormal vectors of the space that ``m - root`` takes to (almost) zero, by inverse iteration."""
    d = len(m)
    a = [[Decimal(m[i][j]) - (root if i == j else 0) for j in range(d)] for i in range(d)]
    tiny = max((abs(v) for row in a for v in row), default=Decimal(1)) * Decimal(10) ** (-DIGITS) or Decimal(1)
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        order[k], order[pivot] = order[pivot], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        top = a[k]
        for i in range(k + 1, d):
            row = a[i]
            if row[k]:
                times = row[k] = row[k] / top[k]
                for j in range(k + 1, d):
                    row[j] -= times * top[j]

    def solved(b: list[Decimal]) -> list[Decimal]:
        y = [b[i] for i in order]
        for i in range(d):
            y[i] -= sum((a[i][j] * y[j] for j in range(i)), Decimal(0))
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
        return y

    def orthonormal(vectors: list[list[Decimal]]) -> list[list[Decimal]]:
        out: list[list[Decimal]] = []
        for v in vectors:
            for _ in range(2):
                for u in out:
                    along = sum((x * y for x, y in zip(u, v, strict=True)), Decimal(0))
                    v = [x - along * y for x, y in zip(v, u, strict=True)]
            norm = sum((x * x for x in v), Decimal(0)).sqrt()
            out.append([x / norm for x in v])
        return out

    rng = np.random.default_rng(seed)
    vectors = orthonormal([[Decimal(int(x)) for x in rng.integers(1, 1 << 30, d)] for _ in range(many)])
    for _ in range(3):
        vectors = orthonormal([solved(v) for v in vectors])
    return vectors


class Components:
    """Of integer vectors: number, sums, and the greatest eigenvalues of their covariance with unit eigenvectors."""

    def __init__(self, spark: SparkSession, fit: DataFrame, many: int = 4):
        self.n, self.sums, products = scatter(fit)
        d = len(self.sums)
        m = [[self.n * products[i][j] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]
        trace = sum(m[i][i] for i in range(d))
        self.vectors, self.eigenvalues, self.shares = np.zeros((0, d)), [], []
        if not trace:
            return
        roots = greatest_roots(characteristic(spark, m), many, trace)
        with localcontext() as context:
            context.prec = DIGITS
            vectors: list[list[Decimal]] = []
            for root in dict.fromkeys(roots):
                value = Decimal(root[0]) / Decimal(1 << root[1])
                vectors += null_vectors(m, value, roots.count(root))
            for k, e in roots:
                value = Decimal(k) / Decimal(1 << e)
                self.eigenvalues.append(float(value / self.n / self.n))
                self.shares.append(float(value / trace))
        self.vectors = np.array([[float(x) for x in v] for v in vectors])


def _projected(x: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Whitened coordinates of rows ``x`` and their exact squared distances from the mean, times ``n * n``."""
    reach = n * _greatest(x) + max(map(abs, sums))
    if reach * reach * x.shape[1] < 2 ** 63:
        centred = n * x - np.array(sums, np.int64)
        return centred / n @ vectors.T / scales, (centred * centred).sum(axis=1).tolist()
    centred = n * x.astype(object) - np.array(sums, object)
    squares = [sum(int(v) * int(v) for v in row) for row in centred]
    return (centred / n).astype(float) @ vectors.T / scales, squares


def whitened(vectors: DataFrame, many: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id``, ``deviation`` (decimal), ``whitened`` (array by component), ``explained`` (array), ``n`` and ``identity_error``.

    ``deviation`` is the exact sum of ``(n * x - S)**2``, null beyond 38 digits. ``identity_error`` is measured on the whitened fit list.
    """
    spark = vectors.sparkSession
    rows = staged(integer_vectors(vectors, scale), "integer-vectors")
    fit = staged(rows.groupBy("x").agg(F.lit(1).alias("once")).select("x"), "fit-list")
    found = Components(spark, fit, many)
    n, sums, axes, count = found.n, found.sums, found.vectors, len(found.vectors)
    scales = np.sqrt(np.array(found.eigenvalues))

    def run(batch: pa.RecordBatch) -> dict | None:
        if not len(batch) or not count:
            return None
        coordinates, squares = _projected(_matrix(batch), n, sums, axes, scales)
        return {"vec_id": batch["vec_id"], "deviation": [Decimal(v) if v < 10 ** 38 else None for v in squares],
                "whitened": list(coordinates)}

    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    inner = map_arrow(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), run, schema)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    errors = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)) for i, j in pairs]
    error = inner.agg(F.greatest(F.lit(0.0), F.lit(0.0), *errors).alias("e")).first().e if count else None
    return map_arrow(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x"), run, schema).select(
        "vec_id", "deviation", "whitened", F.array(*map(F.lit, found.shares)).cast("array<double>").alias("explained"),
        F.lit(n).cast("long").alias("n"), F.lit(error).cast("double").alias("identity_error"))
