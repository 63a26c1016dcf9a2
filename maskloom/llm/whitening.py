"""Whitening of embeddings over an exact characteristic polynomial.

The entries become whole numbers x = floor(1024 * c) + 100000, so the scatter
of the vectors is an integer matrix that tasks sum without rounding.  Its
characteristic polynomial is computed modulo many primes (Hessenberg
reduction, one prime a row of a Spark job) and put together by Chinese
remaindering; its largest roots are isolated by exact counts of sign
variations and refined far beyond double precision; the components are the
null vectors at those roots, by inverse iteration in long decimals.

What the driver holds depends on the dimension only (d * d sums, d + 1
coefficients for each prime), never on the number of vectors.  Defined cases:

* vectors that are null or hold null or non-finite entries are dropped; so are
  vectors shorter than the longest one left, which lack entries;
* repeated rows and ids count and return as often as they occur, null ids too;
* a component of eigenvalue zero (fewer vectors than dimensions, equal vectors)
  returns with a null ``whitened`` and stays out of ``identity_error``;
  ``explained`` is null where the total variance is zero;
* ``deviation`` is null where the exact sum leaves the range of a long;
  ``deviation_exact`` (decimal) holds it at every size;
* an empty table, or one without a usable vector, gives no rows;
* entries of 2**30 and more are refused with an error;
* other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Bits of a limb: a sum of 4096 products of two limbs is exact in a double.
LIMB = 20
LARGEST_ENTRY = 2.0**30
WHOLE = "decimal(38,0)"


# -- the vectors of a batch ---------------------------------------------------


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, x)`` of the usable vectors of a batch, by falling length; x is int64."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in sorted(set(lengths[lengths > 0].tolist()), reverse=True):
        at = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
        v = flat.reshape(-1, dim)
        whole = np.isfinite(v).all(axis=1)
        v = v[whole]
        if v.size and np.abs(v).max() >= LARGEST_ENTRY:
            raise OverflowError("an entry of 2**30 or more is no embedding")
        if len(v):
            yield at[whole], np.floor(SCALE * v).astype(np.int64) + SHIFT


def of_length(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return next((f for f in vectors(column) if f[1].shape[1] == dim), (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))


# -- exact sums over all vectors ------------------------------------------------


def whole_numbers(values) -> pa.Array:
    return pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38))


def first_moments(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Dimension, number and per-dimension sums of the usable vectors (0, 0, [] without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for _, x in vectors(b.column(0)):
                s = sums.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                s[0] += len(x)
                s[1] = s[1] + x.sum(axis=0).astype(object)
        for dim, (n, s) in sums.items():
            yield pa.record_batch([pa.array([dim] * dim), pa.array(range(dim)), pa.array([n] * dim), whole_numbers(s)], ["dim", "i", "n", "s"])

    parts = rows.mapInArrow(run, f"dim long, i long, n long, s {WHOLE}")
    sums = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast(WHOLE).alias("s"))
    longest = sums.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s")).orderBy(F.desc("dim")).first()
    return (longest["dim"], longest["n"], [int(s["s"]) for s in longest["s"]]) if longest else (0, 0, [])


def scatter(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` of an int64 matrix, exact (object array of ints)."""
    limbs = []
    while True:
        low = ((z + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        limbs.append(low.astype(np.float64))
        z = (z - low) >> LIMB
        if not z.any():
            break
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = np.zeros(total.shape, np.int64)
            for r in range(0, len(z), 4096):
                part += (a[r : r + 4096].T @ b[r : r + 4096]).astype(np.int64)
            total += part.astype(object) << (LIMB * (i + j))
    return total


def second_moments(rows: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """n squared times the covariance, in whole numbers: vectors less the whole
    number next to the mean are multiplied, the rest of the mean comes off the sum."""
    dim = len(sums)
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for b in batches:
            total += scatter(of_length(b.column(0), dim)[1] - centre)
        i, j = np.triu_indices(dim)
        yield pa.record_batch([pa.array(i), pa.array(j), whole_numbers(total[i, j])], ["i", "j", "v"])

    cells = rows.mapInArrow(run, f"i long, j long, v {WHOLE}").groupBy("i", "j").agg(F.sum("v").cast(WHOLE).alias("v"))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = [[0] * dim for _ in range(dim)]
    for r in cells.collect():  # d * (d + 1) / 2 rows
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = n * int(r["v"]) - rest[r["i"]] * rest[r["j"]]
    return out


# -- the characteristic polynomial ------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3.2e9 with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """Primes from 2**31 downwards until their product exceeds ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg(m: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``m`` modulo ``p`` with zeros below its first subdiagonal."""
    a, d = m.copy(), len(m)
    for k in range(d - 2):
        nonzero = np.flatnonzero(a[k + 1 :, k])
        if not len(nonzero):
            continue
        r = k + 1 + int(nonzero[0])
        if r != k + 1:
            a[[r, k + 1]] = a[[k + 1, r]]
            a[:, [r, k + 1]] = a[:, [k + 1, r]]
        f = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - f[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * f % p).sum(axis=1)) % p
    return a


def characteristic_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - m) modulo ``p``, from x**0 on."""
    h, d = hessenberg(m, p), len(m)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):  # column k above the diagonal, times the subdiagonal passed on the way
            below = below * int(h[i + 1, i]) % p
            weights[i] = below * int(h[i, k - 1]) % p
        polys[k] = (new - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d].tolist()


def remainders_joined(primes: list[int], remainders: list[list[int]]) -> list[int]:
    """Chinese remaindering, column by column, to numbers from 0 on."""
    product = math.prod(primes)
    parts = [product // p * pow(product // p, -1, p) for p in primes]
    return [sum(r * w for r, w in zip(column, parts)) % product for column in zip(*remainders)]


def characteristic(rows: DataFrame, matrix: list[list[int]]) -> list[int]:
    """det(x - matrix) of a positive semidefinite matrix, from x**0 on.

    With roots of 0 and more, the k-th coefficient from the top is at most
    binomial(d, k) * (trace / d) ** k, and its sign is that of (-1) ** k.
    """
    spark, d = rows.sparkSession, len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(matrix, object)
        for b in batches:
            primes = b.column(0).to_pylist()
            polys = [characteristic_mod((exact % p).astype(np.int64), p) for p in primes]
            yield pa.record_batch([b.column(0), pa.array(polys, pa.list_(pa.int64()))], ["p", "c"])

    table = spark.createDataFrame([(p,) for p in primes_over(bound)], "p long")
    images = table.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "p long, c array<long>").collect()
    primes = [r["p"] for r in images]
    signed = [[c if (d - i) % 2 == 0 else -c % p for i, c in enumerate(r["c"])] for p, r in zip(primes, images)]
    return [c if (d - i) % 2 == 0 else -c for i, c in enumerate(remainders_joined(primes, signed))]


# -- its largest roots ------------------------------------------------------------


def at_grid(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times those of ``poly``."""
    d = len(poly) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than ``a``, each as often as it is multiple: with real roots
    alone, the sign variations of the polynomial shifted by ``a``."""
    c, d = list(poly), len(poly) - 1
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(poly: list[int], x: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * x + c
    return v


def gcd_mod(a: list[int], b: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo ``p``."""
    cut = lambda c: c[: max((i + 1 for i, x in enumerate(c) if x), default=0)]
    a, b = cut([x % p for x in a]), cut([x % p for x in b])
    while b:
        inv, a = pow(b[-1], -1, p), list(a)
        for i in range(len(a) - len(b), -1, -1):
            f = a[i + len(b) - 1] * inv % p
            if f:
                a[i : i + len(b)] = [(x - f * y) % p for x, y in zip(a[i:], b)]
        a, b = b, cut(a)
    inv = pow(a[-1], -1, p)
    return [x * inv % p for x in a]


def quotient(a: list[int], b: list[int]) -> list[int]:
    """``a / b`` for a monic ``b`` that divides ``a``."""
    a, out = list(a), [0] * (len(a) - len(b) + 1)
    for i in range(len(out) - 1, -1, -1):
        out[i] = a[i + len(b) - 1]
        a[i : i + len(b)] = [x - out[i] * y for x, y in zip(a[i:], b)]
    if any(a):
        raise ArithmeticError("not a divisor")
    return out


def squarefree(poly: list[int]) -> list[int]:
    """The polynomial with every root once.  The common divisor with the
    derivative is whole and monic, so it is joined from its images too."""
    slope = [i * c for i, c in enumerate(poly)][1:]
    primes = primes_over(max(abs(c) for c in poly) * 2)
    if len(gcd_mod(poly, slope, primes[0])) == 1:
        return poly  # without a square modulo one prime: without any
    images = [(gcd_mod(poly, slope, p), p) for p in primes]
    least = min(len(g) for g, _ in images)
    images = [(g, p) for g, p in images if len(g) == least]
    signed = [[c if (least - 1 - i) % 2 == 0 else -c % p for i, c in enumerate(g)] for g, p in images]
    whole = remainders_joined([p for _, p in images], signed)
    return quotient(poly, [c if (least - 1 - i) % 2 == 0 else -c for i, c in enumerate(whole)])


def isolated(single: list[int], trace: int, count: int) -> tuple[int, list[tuple[int, int]]]:
    """``(bits, cells)``: for each of the ``count`` largest roots a cell (a, b] of the
    grid of 2**-bits that holds no other root.  ``single`` has every root once."""
    bits, cells = 0, [(-1, trace)] * min(count, len(single) - 1)
    while True:
        grid, seen = at_grid(single, bits), {}

        def above(a: int) -> int:
            if a not in seen:
                seen[a] = roots_above(grid, a)
            return seen[a]

        for j, (a, b) in enumerate(cells):
            while b - a > 1 and (above(a) != j + 1 or above(b) != j):
                mid = (a + b) // 2
                a, b = (mid, b) if above(mid) > j else (a, mid)
            cells[j] = (a, b)
        if all(above(a) == j + 1 and above(b) == j for j, (a, b) in enumerate(cells)):
            return bits, cells
        bits, cells = bits + 32, [(a << 32, b << 32) for a, b in cells]


def refined(single: list[int], cell: tuple[int, int], bits: int, more: int) -> int:
    """The root of a cell as a multiple of 2**-(bits + more), rounded up."""
    grid, (a, b) = at_grid(single, bits + more), (cell[0] << more, cell[1] << more)
    end = value(grid, b)
    while end and b - a > 1:
        mid = (a + b) // 2
        v = value(grid, mid)
        if v == 0:
            return mid
        a, b = (a, mid) if (v > 0) == (end > 0) else (mid, b)
    return b


class Root(NamedTuple):
    value: Fraction
    multiple: int


def largest_roots(poly: list[int], trace: int, count: int) -> tuple[list[Root], int]:
    """The largest roots until ``count`` with their multiples, apart from each
    other and from the next one by far more than their error 2**-bits; ``bits``."""
    single = squarefree(poly)
    bits, cells = isolated(single, trace, count + 1)
    grid = at_grid(poly, bits)
    multiple = [roots_above(grid, a) - roots_above(grid, b) for a, b in cells]
    more = 192
    while True:
        fine = [refined(single, c, bits, more) for c in cells]
        if all(x - y >> 128 for x, y in zip(fine, fine[1:])):
            break
        more += 192
    roots, have = [], 0
    for x, m in zip(fine, multiple):
        if have >= count:
            break
        roots.append(Root(Fraction(x, 1 << (bits + more)), m))
        have += m
    return roots, bits + more


# -- components -------------------------------------------------------------------


def solver(matrix: list[list[int]], shift: decimal.Decimal) -> Callable[[list], list]:
    """Solves (matrix - shift) x = b, by one factorisation with row pivots."""
    d = len(matrix)
    a = [[decimal.Decimal(v) for v in row] for row in matrix]
    for i in range(d):
        a[i][i] -= shift
    order = list(range(d))
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[r], order[k], order[r] = a[r], a[k], order[r], order[k]
        top = a[k]
        for i in range(k + 1, d):
            if a[i][k]:
                row = a[i]
                f = row[k] = row[k] / top[k]
                row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], top[k + 1 :])]

    def solve(b: list) -> list:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum((f * y for f, y in zip(a[i][:i], x)), decimal.Decimal(0))
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - sum((f * y for f, y in zip(a[i][i + 1 :], x[i + 1 :])), decimal.Decimal(0))) / a[i][i]
        return x

    return solve


def unit(v: list) -> list | None:
    size = sum(x * x for x in v).sqrt()
    return [x / size for x in v] if size else None


def null_vectors(matrix: list[list[int]], root: Root, bits: int) -> list[list[float]]:
    """An orthonormal basis of the null space of (matrix - root), by inverse iteration."""
    d = len(matrix)
    with decimal.localcontext() as ctx:
        scale = 1 + max(abs(v) for row in matrix for v in row)
        ctx.prec = 40 + int(0.302 * (bits + scale.bit_length() + d))
        # beside the root by its error, so that no pivot is zero
        at = decimal.Decimal(root.value.numerator) / root.value.denominator + decimal.Decimal(2) ** (4 - bits)
        solve, found = solver(matrix, at), []
        starts = [[decimal.Decimal(2 * i % 7 + 3) / (i % 11 + 2) for i in range(d)]] + [[decimal.Decimal(int(i == k)) for i in range(d)] for k in range(d)]
        for v in starts:
            for _ in range(3):
                for f in found:
                    along = sum(x * y for x, y in zip(f, v))
                    v = [y - along * x for x, y in zip(f, v)]
                v = unit(v)
                v = v and unit(solve(v))
                if v is None:
                    break
            if v is None or any(abs(sum(x * y for x, y in zip(f, v))) > decimal.Decimal(2) ** -80 for f in found):
                continue
            miss = max(abs(sum(m * x for m, x in zip(row, v)) - at * y) for row, y in zip(matrix, v))
            if miss > scale * decimal.Decimal(2) ** -80:
                continue
            found.append(v)
            if len(found) == root.multiple:
                break
        if len(found) < root.multiple:
            raise ArithmeticError("inverse iteration found too few null vectors")
        out = [[float(x) for x in v] for v in found]
    lead = [max(range(d), key=lambda i: (abs(v[i]), -i)) for v in out]
    return [[x if v[k] > 0 else -x for x in v] for v, k in zip(out, lead)]


class Model(NamedTuple):
    """What whitening needs of the fit list; its size depends on the dimension alone."""

    n: int
    sums: list[int]
    #: Eigenvalue, share of the trace (None: no variance) and unit vector (None: eigenvalue zero) by component.
    components: list[tuple[float, float | None, list[float] | None]]


def fit(vectors_: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Components of all usable vectors (None: there is none)."""
    rows = vectors_.select(F.col(vector_col)).where(F.col(vector_col).isNotNull())
    dim, n, sums = first_moments(rows)
    if not n:
        return None
    matrix = second_moments(rows, n, sums)
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return Model(n, sums, [(0.0, None, None)] * min(components, dim))
    roots, bits = largest_roots(characteristic(rows, matrix), trace, components)
    out: list[tuple[float, float | None, list[float] | None]] = []
    for root in roots:
        e, share = float(root.value / n**2), float(root.value / trace)
        vs = null_vectors(matrix, root, bits) if root.value > 0 else [None] * root.multiple
        out += [(e, share, v) for v in vs]
    return Model(n, sums, out[:components])


# -- whitening --------------------------------------------------------------------


class _Rows:
    """Whitened values and deviations of batches, in the tasks."""

    def __init__(self, model: Model):
        self.n, self.dim = model.n, len(model.sums)
        self.centre = np.array([round(Fraction(s, model.n)) for s in model.sums], np.int64)
        self.rest = [s - model.n * int(c) for s, c in zip(model.sums, self.centre)]
        self.offset = np.array([float(Fraction(r, model.n)) for r in self.rest])
        self.used = [k for k, c in enumerate(model.components) if c[2] is not None]
        axes = [np.array(model.components[k][2]) / math.sqrt(model.components[k][0]) for k in self.used]
        self.axes = np.array(axes).reshape(len(axes), self.dim).T

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(places, whitened by used component, z)`` of the usable vectors."""
        at, x = of_length(column, self.dim)
        z = x - self.centre
        return at, (z - self.offset) @ self.axes, z

    def deviations(self, z: np.ndarray) -> np.ndarray:
        """Exact sums of (n * x - S) ** 2."""
        small = not len(z) or int(np.abs(z).max()) < 1 << 24
        whole = z if small and self.n < 1 << 31 and self.dim < 1 << 7 else z.astype(object)
        squares, along = (whole * whole).sum(axis=1), (whole * np.array(self.rest, whole.dtype)).sum(axis=1)
        return self.n**2 * squares.astype(object) - 2 * self.n * along.astype(object) + sum(r * r for r in self.rest)


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the
    identity, measured on all of them (None: no component of positive eigenvalue)."""
    k = sum(c[2] is not None for c in model.components)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten, total = _Rows(model), np.zeros((k + 1, k))
        for b in batches:
            _, w, _ = whiten(b.column(0))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    sums = np.zeros((k + 1, k))
    for r in rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whitened(vectors_: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``<id>, component, n, deviation,
    whitened, explained, identity_error, deviation_exact`` (cases: see the module)."""
    source = vectors_.select(F.col(id_col), F.col(vector_col))
    id_type = source.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact {WHOLE}"
    rows = source.where(F.col(vector_col).isNotNull())
    model = fit(rows, vector_col, components)
    if model is None:
        return vectors_.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows.select(vector_col), model), len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten = _Rows(model)
        explained = pa.array([c[1] for c in model.components], pa.float64())
        for b in batches:
            at, w, z = whiten(b.column(1))
            if not len(at):
                continue
            values = np.full((len(at), k), np.nan)
            values[:, whiten.used] = w
            lacks = np.ones(k, bool)
            lacks[whiten.used] = False
            exact = whiten.deviations(z)
            fits = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
            each, part = pa.array(np.repeat(np.arange(len(at)), k)), np.tile(np.arange(k), len(at))
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(at)).take(each), pa.array((part + 1).astype(np.int32)), pa.array(np.full(len(part), whiten.n)),
                    fits.take(each), pa.array(values.ravel(), mask=np.tile(lacks, len(at))), explained.take(pa.array(part)),
                    pa.array([error] * len(part), pa.float64()), whole_numbers(exact).take(each),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return rows.mapInArrow(run, schema)
