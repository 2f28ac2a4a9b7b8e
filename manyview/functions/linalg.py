"""3-vectors, 3x3 matrices and symmetric 4x4 matrices as Spark columns; all stays in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = list[list[Column]]


def vector(prefix: str, names: str = "xyz") -> Vector:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def rotation(prefix: str = "") -> Matrix:
    return [[F.col(f"{prefix}r{i}{j}") for j in range(3)] for i in range(3)]


def transposed(m: Matrix) -> Matrix:
    return [list(row) for row in zip(*m)]


def times(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(row, column) for column in zip(*b)] for row in a]


def applied(m: Matrix, v: Sequence[Column]) -> Vector:
    return tuple(dot(row, v) for row in m)


def det3(m: Matrix) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def clean(column: Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    return F.round(column, digits) + F.lit(0.0)


def adjugate4(m: Matrix) -> Matrix:
    """Adjugate of a 4x4 matrix, by 3x3 minors."""

    def minor(i: int, j: int) -> Column:
        rows = [[m[r][c] for c in range(4) if c != j] for r in range(4) if r != i]
        return det3(rows)

    return [[minor(j, i) * (-1 if (i + j) % 2 else 1) for j in range(4)] for i in range(4)]


#: Index pairs of the ten different entries of a symmetric 4x4 matrix.
UPPER = [(i, i) for i in range(4)] + list(combinations(range(4), 2))


def finite(*columns: Column) -> Column:
    """Every value is there, and neither NaN nor infinite."""
    tests = [F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)) for c in columns]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """df.select(keep, columns), with the columns computed where they stand.

    A later filter on a column that a projection computes is pushed below it with the whole expression in its place; with
    several projections that grows exponentially. Filters don't pass a generator, so this gives the columns as the one
    row of one.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
