"""Small matrices and vectors as Column expressions: arrays of doubles, matrices by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelith.functions.pixels import num

#: A pivot below this makes a matrix singular.
SINGULAR = 1e-20


def entry(m: Column, i: int, j: int, width: int = 3) -> Column:
    return F.get(m, F.lit(i * width + j))


def matrix_product(a: Column, b: Column, n: int = 3) -> Column:
    """The product of two n x n matrices."""
    cells = []
    for i in range(n):
        for j in range(n):
            total = entry(a, i, 0, n) * entry(b, 0, j, n)
            for k in range(1, n):
                total = total + entry(a, i, k, n) * entry(b, k, j, n)
            cells.append(total)
    return F.array(*cells)


def transposed(m: Column, rows: int = 3, width: int = 3) -> Column:
    return F.array(*[entry(m, i, j, width) for j in range(width) for i in range(rows)])


def determinant(m: Column) -> Column:
    """Of a 3 x 3 matrix, along its first row."""
    return entry(m, 0, 0) * _minor(m, 0, 0) - entry(m, 0, 1) * _minor(m, 0, 1) + entry(m, 0, 2) * _minor(m, 0, 2)


def _minor(m: Column, i: int, j: int) -> Column:
    (a, b), (c, d) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    return entry(m, a, c) * entry(m, b, d) - entry(m, a, d) * entry(m, b, c)


def inverse(m: Column) -> Column:
    """Of a 3 x 3 matrix, by cofactors; null where it has none."""
    det = determinant(m)
    whole = F.when(F.abs(det) >= SINGULAR, det)
    return F.when(whole.isNotNull(), F.array(*[_minor(m, j, i) * num(1.0 if (i + j) % 2 == 0 else -1.0) / whole for i in range(3) for j in range(3)]))


def scaled(m: Column, by: Column) -> Column:
    return F.transform(m, lambda x: x * by)


def blended(a: Column, b: Column, weight: Column) -> Column:
    """weight * a + (1 - weight) * b."""
    return F.zip_with(a, b, lambda x, y: weight * x + (num(1.0) - weight) * y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), num(0.0), lambda s, x: s + x))


def diagonal(v: Column, n: int = 3) -> Column:
    """The n x n matrix with v on its diagonal."""
    return F.array(*[F.get(v, F.lit(i)) if i == j else num(0.0) for i in range(n) for j in range(n)])


def rational(x: Column, most: int = 1 << 31) -> tuple[Column, Column]:
    """A fraction for x: the least power of ten, 10 ** 9 at most, that makes it whole, or the last one that fits; 0/1 for what
    is not finite."""
    finite = ~F.isnan(x) & (F.abs(x) < num(float("inf")))
    d = num(1e9)
    for power in range(8, -1, -1):
        p = 10.0**power
        d = F.when((x * p == F.floor(x * p)) | (F.abs(x) * num(p * 10) >= num(float(most))), num(p)).otherwise(d)
    n = F.round(F.when(finite, x) * d)
    return F.when(finite, n.cast("long")).otherwise(0), F.when(finite, d.cast("long")).otherwise(1)
