"""Vectors as ARRAY<DOUBLE> expressions. Binary operations raise where lengths differ; null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(a: Column) -> Column:
    return a.cast("array<double>")


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def _paired(a: Column, b: Column, f: Callable[[Column, Column], Column], value: Callable[[Column], Column] = lambda x: x) -> Column:
    differ = F.concat(F.lit("lengths differ: "), F.size(a), F.lit(" and "), F.size(b))
    fails = F.raise_error(differ)
    result = value(F.zip_with(a, b, f))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), result).otherwise(fails)


def add(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def hadamard(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def scale(a: Column, s: Column | float) -> Column:
    k = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(a, lambda x: x * k)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """The sum of products from left to right."""
    return _paired(a, b, lambda x, y: x * y, _sum)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalize(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def euclidean(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y), lambda d: F.sqrt(_sum(d)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def read_vector(v: Column) -> Column:
    """The vector in a VARIANT array of numbers; null if it is none or holds anything else."""
    from .values import kind

    items = F.try_variant_get(v, "$", "array<variant>")
    ok = (kind(v) == "array") & F.forall(items, lambda x: F.coalesce(kind(x).isin("int", "float"), F.lit(False)))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(items, lambda x: F.try_variant_get(x, "$", "double")))


def read_matrix(v: Column) -> Column:
    """The matrix in a VARIANT array of rows as ARRAY<ARRAY<DOUBLE>>; null if a row is none or rows differ in length. An
    empty array is the matrix without rows."""
    from .values import kind

    rows = F.transform(F.try_variant_get(v, "$", "array<variant>"), read_vector)
    ok = (kind(v) == "array") & F.forall(rows, lambda r: r.isNotNull() & (F.size(r) == F.size(rows[0])))
    return F.when(F.coalesce(ok, F.lit(False)), rows)
