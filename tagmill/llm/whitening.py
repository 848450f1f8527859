"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

The scatter is n^2 times the covariance and all integers: n * sum(x x^T) - S S^T. Its characteristic polynomial is
found modulo many primes, in Spark tasks, and put together by Chinese remainders; real roots are isolated by counting sign
changes, which is exact where all roots are real; each root's null space is found by inverse iteration in long decimals.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import bounded_batches
from tagmill.written import cut

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Decimal digits beyond those that tell neighbouring roots apart, and rows multiplied at a time.
DIGITS, ROWS = 40, 4096
#: Limbs of 2**32 that carry a sum from the tasks: sums below 2**255 in size.
LIMBS, LIMB = 8, 32
#: No product of two entries within this bound and no sum of ROWS of them leaves what a double holds exactly.
_EXACT = 1 << 20
#: Largest size of 64 * c, so that x is a long.
_MOST = float(1 << 61)


# sums


def as_integers(embedding: str = "embedding") -> Column:
    """x = floor(64 * c) + 1000000 of each entry c as double; entries beyond a long stop at 2**61."""
    scaled = lambda c: F.least(F.greatest(F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"), F.lit(-_MOST)), F.lit(_MOST))
    return F.transform(embedding, lambda c: scaled(c).cast("long") + F.lit(SHIFT).cast("long"))


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector is not null and all its entries are there and finite; a zero vector is."""
    return F.col(embedding).isNotNull() & ~F.coalesce(F.exists(embedding, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, d) of a column of arrays of long, less SHIFT, which no covariance sees."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) - SHIFT


def _limbs(value: int) -> list[int]:
    """``value`` in LIMBS parts of 2**LIMB; the last one carries the sign."""
    parts = []
    for _ in range(LIMBS - 1):
        parts.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*parts, value]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, limbs) of a task's sums: place 0 counts, then sums by dimension, then sums of products i <= j, row by row."""
    count, sums, squares = 0, None, None
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            x = _matrix(batch.column(0).slice(a, ROWS))
            if np.abs(x).max(initial=0) <= _EXACT:
                wide = x.astype(np.float64)
                one, two = x.sum(0).astype(object), (wide.T @ wide).astype(np.int64).astype(object)
            else:
                wide = x.astype(object)
                one, two = wide.sum(0), wide.T @ wide
            count += len(x)
            sums, squares = (one, two) if sums is None else (sums + one, squares + two)
    if count:
        upper = squares[np.triu_indices(len(sums))]
        values = [count, *map(int, sums), *map(int, upper)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array([_limbs(v) for v in values], pa.list_(pa.int64()))], ["place", "limbs"])


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums S and sums of products of the vectors ``x`` of ``fit``, less SHIFT, exactly; (d + 1)(d + 2) / 2 numbers come back."""
    part = fit.select("x").mapInArrow(_products, "place long, limbs array<long>")
    added = part.groupBy("place").agg(*(F.sum(F.col("limbs")[i].cast("decimal(38,0)")).alias(f"l{i}") for i in range(LIMBS)))
    found = {r.place: sum(int(r[f"l{i}"]) << (LIMB * i) for i in range(LIMBS)) for r in added.collect()}
    if not found:
        return 0, [0] * d, [[0] * d for _ in range(d)]
    products, at = [[0] * d for _ in range(d)], d + 1
    for i in range(d):
        for j in range(i, d):
            products[i][j] = products[j][i] = found[at]
            at += 1
    return found[0], [found[i + 1] for i in range(d)], products


def scatter(n: int, sums: list[int], products: list[list[int]]) -> list[list[int]]:
    """n * sum(x x^T) - S S^T: n^2 times the covariance."""
    return [[n * p - si * sj for p, sj in zip(row, sums, strict=True)] for row, si in zip(products, sums, strict=True)]


# the polynomial


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2**32): trial division by Miller-Rabin to bases 2, 3, 5, 7."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            y = pow(base, odd, p)
            if y in (1, p - 1):
                continue
            for _ in range(twos - 1):
                y = y * y % p
                if y == p - 1:
                    break
            else:
                return False
        return True

    found, p = [], top - 1 - top % 2
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(yI - matrix) modulo ``p`` < 2**31, lowest first: reduction to Hessenberg form, then its recurrence."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        below = np.nonzero(h[k + 1 :, k])[0]
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    told = np.zeros((d + 1, d + 1), np.int64)
    told[0, 0] = 1
    for k in range(d):
        told[k + 1, 1:] = told[k, :-1]
        factor = h[: k + 1, k].copy()
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            factor[i] = factor[i] * run % p
        told[k + 1] = (told[k + 1] - (factor[:, None] * told[: k + 1] % p).sum(0)) % p
    return told[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(yI - matrix), lowest first, of a positive semidefinite integer matrix.

    The k-th elementary sum of its eigenvalues is at most C(d, k) (trace / d)^k, which tells how many primes are enough.
    Primes are dealt over Spark tasks; each gives d + 1 residues back.
    """
    d = len(matrix)
    mean = sum(matrix[i][i] for i in range(d)) // d + 1
    bound = 2 * max(math.comb(d, k) * mean**k for k in range(d + 1)) + 1
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.array(shared.value, object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [polynomial_mod((wide % p).astype(np.int64), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["p", "residues"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    rows = dealt.mapInArrow(run, "p long, residues array<long>").collect()
    value, modulus = [0] * (d + 1), 1
    for r in rows:
        inverse = pow(modulus, -1, r.p)
        value = [v + modulus * ((x - v) * inverse % r.p) for v, x in zip(value, r.residues, strict=True)]
        modulus *= r.p
    return [v - modulus if v > modulus // 2 else v for v in value]


# roots


def _value(poly: list[int], at: int, bits: int) -> int:
    """2^(bits * degree) times the value of ``poly`` at at / 2^bits."""
    total = 0
    for i, c in enumerate(reversed(poly)):
        total = total * at + (c << (bits * i))
    return total


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots of ``poly`` exceed at / 2^bits, each as often as it counts; all its roots must be real.

    These are the sign changes among the coefficients of the polynomial shifted by that point.
    """
    d = len(poly) - 1
    moved = [c << (bits * (d - i)) for i, c in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            moved[j] += at * moved[j + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _primitive(poly: list[int]) -> list[int]:
    while poly and poly[-1] == 0:
        poly = poly[:-1]
    common = math.gcd(*poly) if poly else 1
    return [c // common for c in poly]


def _divided(a: list[int], b: list[int]) -> tuple[list[Fraction], list[Fraction]]:
    """Quotient and remainder of ``a`` by ``b``."""
    rest, quotient = [Fraction(c) for c in a], [Fraction(0)] * max(0, len(a) - len(b) + 1)
    for i in range(len(a) - len(b), -1, -1):
        quotient[i] = rest[i + len(b) - 1] / b[-1]
        for j, c in enumerate(b):
            rest[i + j] -= quotient[i] * c
    return quotient, rest[: len(b) - 1]


def _whole(poly: list[Fraction]) -> list[int]:
    scale = math.lcm(*(c.denominator for c in poly)) if poly else 1
    return _primitive([int(c * scale) for c in poly])


def square_free(poly: list[int]) -> list[int]:
    """The polynomial with each root of ``poly`` once: divided by what it shares with its derivative.

    A prime that sees no shared factor proves that there is none; only else the exact division is made.
    """
    slope = [i * c for i, c in enumerate(poly)][1:]
    for p in primes_below(1 << 30, 3):
        a, b = [c % p for c in poly], [c % p for c in slope]
        while b and b[-1] == 0:
            b.pop()
        if a[-1] == 0 or not b:
            continue
        while b:
            inverse = pow(b[-1], -1, p)
            while len(a) >= len(b):
                factor, gap = a[-1] * inverse % p, len(a) - len(b)
                for j, c in enumerate(b):
                    a[gap + j] = (a[gap + j] - factor * c) % p
                while a and a[-1] == 0:
                    a.pop()
            a, b = b, a
        if len(a) == 1:
            return poly
    a, b = _primitive(poly), _primitive(slope)
    while b:
        _, rest = _divided(a, b)
        a, b = b, _whole(rest)
    return _whole(_divided(poly, a)[0])


class Root:
    """A root between low / 2^bits (not the root itself, unless exact) and high / 2^bits, and how often it counts."""

    def __init__(self, low: int, high: int, bits: int, times: int):
        self.low, self.high, self.bits, self.times = low, high, bits, times

    def narrowed(self, poly: list[int], bits: int) -> Root:
        """The same root between neighbours on the grid of 2^-bits; ``poly`` has it once and changes its sign there."""
        low, high = self.low << (bits - self.bits), self.high << (bits - self.bits)
        if high - low <= 1:
            return Root(low, high, bits, self.times)
        at_high = _value(poly, high, bits)
        if at_high == 0:
            return Root(high - 1, high, bits, self.times)
        positive = at_high > 0
        while high - low > 1:
            mid = (low + high) // 2
            value = _value(poly, mid, bits)
            if value == 0:
                return Root(mid - 1, mid, bits, self.times)
            low, high = (low, mid) if (value > 0) == positive else (mid, high)
        return Root(low, high, bits, self.times)

    def middle(self) -> Fraction:
        return Fraction(self.low + self.high, 2 << self.bits)


def largest_roots(poly: list[int], most: int) -> list[Root]:
    """The largest roots of ``poly``, falling, until ``most`` are there counted as often as they are, and one more to part them from; only positive ones.

    Each lies alone in its interval (low, high].
    """
    single = square_free(poly)
    bits, top = 0, 1
    while roots_above(single, top, 0):
        top *= 2
    found: list[Root] = []
    pending = [(0, top, 0, roots_above(single, 0, 0), 0)]  # (low, high, bits, roots above low, roots above high)
    while pending and sum(r.times for r in found) <= most:
        low, high, bits, above, beyond = pending.pop()
        if above == beyond:
            continue
        if above - beyond == 1:
            times = 1 if len(single) == len(poly) else roots_above(poly, low, bits) - roots_above(poly, high, bits)
            found.append(Root(low, high, bits, times))
            continue
        if high - low == 1:
            low, high, bits = low * 2, high * 2, bits + 1
        mid = (low + high) // 2
        between = roots_above(single, mid, bits)
        pending += [(low, mid, bits, above, between), (mid, high, bits, between, beyond)]
    return found


# components


def _solved(matrix: list[list[Decimal]], sides: list[list[Decimal]], tiny: Decimal) -> list[list[Decimal]]:
    """Solutions of matrix * y = side for each side: elimination with the largest pivot of a column; a zero pivot becomes ``tiny``."""
    d = len(matrix)
    a = np.array([[*row, *(s[i] for s in sides)] for i, row in enumerate(matrix)], object)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = tiny
        a[k + 1 :, k:] -= (a[k + 1 :, k] / a[k, k])[:, None] * a[k, k:]
    y = np.empty((d, len(sides)), object)
    for k in range(d - 1, -1, -1):
        y[k] = (a[k, d:] - (a[k, k + 1 : d] @ y[k + 1 :] if k + 1 < d else Decimal(0))) / a[k, k]
    return [list(y[:, i]) for i in range(len(sides))]


def null_space(matrix: list[list[int]], root: tuple[int, int], times: int, digits: int) -> list[list[float]]:
    """``times`` orthonormal vectors that (matrix - root) takes to nearly zero; ``root`` is a fraction, good to ``digits``.

    Two steps of inverse iteration from fixed start vectors, orthogonalised after each.
    """
    with decimal.localcontext() as context:
        context.prec = digits
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        value = Decimal(root[0]) / Decimal(root[1])
        d = len(matrix)
        shifted = [[Decimal(c) - (value if i == j else 0) for j, c in enumerate(row)] for i, row in enumerate(matrix)]
        tiny = max(abs(value), Decimal(1)).scaleb(-digits)
        rng = np.random.default_rng(7)
        sides = [[Decimal(int(c)) for c in rng.integers(-999, 1000, d)] for _ in range(times)]
        for _ in range(2):
            sides = _solved(shifted, sides, tiny)
            kept: list[list[Decimal]] = []
            for side in sides:
                for _ in range(2):
                    for k in kept:
                        along = sum(x * y for x, y in zip(side, k, strict=True))
                        side = [x - along * y for x, y in zip(side, k, strict=True)]
                    length = sum(x * x for x in side).sqrt()
                    side = [x / length for x in side]
                kept.append(side)
            sides = kept
        return [[float(x) for x in side] for side in sides]


def components(spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS) -> tuple[list[list[float]], list[Fraction]]:
    """Unit eigenvectors and eigenvalues of ``matrix``, by falling eigenvalue, ``most`` at most; zero ones are left out.

    A root is narrowed until its error is 10^-DIGITS of itself and of its distance to its neighbours; null spaces are found in Spark tasks.
    """
    if not matrix or not any(any(row) for row in matrix):
        return [], []
    poly = characteristic_polynomial(spark, matrix)
    single, found = square_free(poly), largest_roots(poly, most)
    fine = math.ceil(DIGITS * math.log2(10))
    jobs, values, count = [], [], 0
    for i, root in enumerate(found):
        if count >= most:
            break
        bits = max(r.bits for r in found[max(0, i - 1) : i + 2]) + 2
        near = [r.narrowed(single, bits) for r in found[max(0, i - 1) : i + 2]]
        own = near[min(i, 1)]
        while True:  # until the neighbours are further off than the interval is wide
            gaps = [abs(r.low - own.low) for r in near if r is not own]
            if own.low > 4 and all(g > 8 for g in gaps):
                break
            bits += 8
            near = [r.narrowed(single, bits) for r in near]
            own = near[min(i, 1)]
        exact = own.narrowed(single, bits + fine)
        middle = exact.middle()
        closest = min([own.low, *gaps])
        digits = 2 * DIGITS + len(str((found[0].high << (bits - found[0].bits)) // closest))
        times = min(root.times, most - count)
        jobs.append((len(jobs), f"{middle.numerator}", f"{middle.denominator}", times, digits))
        values += [middle] * times
        count += times
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                vectors = null_space(shared.value, (int(job["top"]), int(job["bottom"])), job["times"], job["digits"])
                yield pa.RecordBatch.from_arrays([pa.array([job["job"]] * len(vectors), pa.int64()), pa.array(range(len(vectors)), pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], ["job", "nth", "vector"])

    dealt = spark.createDataFrame(jobs, "job long, top string, bottom string, times long, digits long").repartition(min(len(jobs), spark.sparkContext.defaultParallelism))
    rows = dealt.mapInArrow(run, "job long, nth long, vector array<double>").collect()
    return [list(r.vector) for r in sorted(rows, key=lambda r: (r.job, r.nth))], values


# whitening


class Whitener:
    """Projection on components: what a row needs, d * components numbers and the exact sums."""

    def __init__(self, n: int, sums: list[int], vectors: list[list[float]], values: list[Fraction], trace: int):
        self.n, self.sums = n, sums
        self.vectors = np.array(vectors, np.float64).reshape(len(vectors), len(sums)).T
        # the eigenvalue of the covariance is that of the scatter over n^2, so sqrt(e) is sqrt(value) / n
        self.roots = np.array([_square_root(v) for v in values], np.float64)
        self.explained = [float(v / trace) for v in values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs where these hold it, else in Python's integers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.vectors / self.roots


def _square_root(value: Fraction) -> float:
    with decimal.localcontext() as context:
        context.prec = 40
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        return float((Decimal(value.numerator) / Decimal(value.denominator)).sqrt())


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exact; None where a long can't hold it."""
    if centred.dtype != object and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 62:
        return (centred * centred).sum(1).tolist()
    sums = [sum(int(c) ** 2 for c in row) for row in centred]
    return [s if s < 1 << 63 else None for s in sums]


def identity_error(fit: DataFrame, made: Whitener) -> float:
    """The largest entry of the covariance of whitened ``fit`` less the identity: a pass for the means, one for products about them."""
    shared = fit.sparkSession.sparkContext.broadcast(made)
    k = made.vectors.shape[1]

    def summed(about: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if about is None else k * k)
            for batch in batches:
                for a in range(0, len(batch), ROWS):
                    w = shared.value.whitened(shared.value.centred(_matrix(batch.column(0).slice(a, ROWS))))
                    total += w.sum(0) if about is None else ((w - about).T @ (w - about)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "total"])

        rows = fit.select("x").mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        return np.array([r.total for r in sorted(rows)]) / made.n

    return float(np.abs(summed(summed(None)).reshape(k, k) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding).

    Vectors that are null or hold null or non-finite entries are dropped, as are those of another length than the most frequent
    one (ties: the shorter). Each distinct integer vector is fitted on once, however many rows share it; every row left is
    projected, also rows that share an id or have none. Components of eigenvalue zero are left out, as nothing can be
    divided by it: fewer than two distinct vectors give no row. A deviation beyond a long is null. Of a multiple
    eigenvalue any orthonormal basis is taken. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select("vec_id", "embedding").filter(usable()).filter(F.size("embedding") > 0)
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], schema)
    whole = rows.filter(F.size("embedding") == size.d).select("vec_id", as_integers().alias("x"))
    fit = cut(whole.select("x").distinct(), "fit")
    n, sums, products = exact_sums(fit, size.d)
    matrix = scatter(n, sums, products)
    found, values = components(spark, matrix, most)
    if not found:
        return spark.createDataFrame([], schema)
    made = Whitener(n, sums, found, values, sum(matrix[i][i] for i in range(size.d)))
    error = identity_error(fit, made)
    shared = spark.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, k = shared.value, len(shared.value.explained)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                centred = made.centred(_matrix(part.column(1)))
                repeat = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(repeat), made.n, np.int64)),
                        pa.array(_deviations(centred), pa.int64()).take(pa.array(repeat)), pa.array(made.whitened(centred).reshape(-1)), pa.array(np.tile(np.array(made.explained), len(part))), pa.array(np.full(len(repeat), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.mapInArrow(run, schema)
