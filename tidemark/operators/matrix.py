"""Matrices in long form (i, j, v), spread over the cluster, and similarity search over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linalg
from ..plans.skew import col, fresh
from ..session import ship
from .access import KEY

#: Rows and columns of a block in which matrices are multiplied.
BLOCK = 64


def filled(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {max(cols, 1)}").alias("i"), (F.col("id") % max(cols, 1)).alias("j"), F.lit(float(value)).alias("v"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return filled(spark, n, n).withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def from_rows(df: DataFrame, row: str, values: str) -> DataFrame:
    """From one array a row; raises for rows of different lengths when the rows are read."""
    n = df.agg(F.max(F.size(col(values)))).first()[0] or 0
    checked = F.when(F.size(col(values)) == n, col(values)).otherwise(F.raise_error(F.lit("rows differ in length")))
    return df.select(col(row).cast("long").alias("i"), F.posexplode(checked).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def from_flat(df: DataFrame, values: str, rows: int, cols: int) -> DataFrame:
    """From one row-major array; raises if it doesn't have rows times cols values."""
    checked = F.when(F.size(col(values)) == rows * cols, col(values)).otherwise(F.raise_error(F.lit("wrong number of values")))
    return df.select(F.posexplode(checked).alias("p", "v")).select(F.expr(f"cast(p div {cols} as long)").alias("i"), (F.col("p") % cols).cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def to_rows(m: DataFrame) -> DataFrame:
    """(i, values), one array a row."""
    return m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("values"))


def shape(m: DataFrame) -> tuple[int, int]:
    i, j = m.agg(F.max("i"), F.max("j")).first()
    return (0, 0) if i is None else (i + 1, j + 1)


def get(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.filter((F.col("i") == i) & (F.col("j") == j))


def set_cell(m: DataFrame, i: int, j: int, v: float) -> DataFrame:
    return m.withColumn("v", F.when((F.col("i") == i) & (F.col("j") == j), F.lit(float(v))).otherwise(F.col("v")))


def _same_shape(a: DataFrame, b: DataFrame) -> None:
    if shape(a) != shape(b):
        raise ValueError(f"shapes differ: {shape(a)} and {shape(b)}")


def _cellwise(a: DataFrame, b: DataFrame, sign: int) -> DataFrame:
    """One shuffle: cells of both are added up, rather than joined."""
    _same_shape(a, b)
    both = a.select("i", "j", F.col("v").alias("v")).unionAll(b.select("i", "j", (F.col("v") * sign).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cellwise(a, b, 1)


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cellwise(a, b, -1)


def scale(m: DataFrame, s: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * F.lit(float(s)))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _blocks(m: DataFrame, side: int, names: tuple[str, str, str]) -> DataFrame:
    """One row a block that has cells: its row and column of blocks, and its cells as (place, value)."""
    cell = F.struct(((F.col("i") % side) * side + F.col("j") % side).cast("int").alias("p"), F.col("v"))
    return m.groupBy(F.expr(f"i div {side}").alias(names[0]), F.expr(f"j div {side}").alias(names[1])).agg(F.collect_list(cell).alias(names[2]))


def _product(side: int):
    """Sums of the products of pairs of blocks, one row a block of the result and batch."""

    def dense(cells) -> tuple[np.ndarray, np.ndarray]:
        m, there = np.zeros(side * side), np.zeros(side * side, bool)
        p = cells.field(0).to_numpy(zero_copy_only=False)
        m[p], there[p] = cells.field(1).to_numpy(zero_copy_only=False), True
        return m.reshape(side, side), there.reshape(side, side)

    def times(x: np.ndarray, y: np.ndarray, there: np.ndarray) -> np.ndarray:
        odd_x, odd_y = ~np.isfinite(x), ~np.isfinite(y)
        out = np.where(odd_x, 0, x) @ np.where(odd_y, 0, y)
        with np.errstate(invalid="ignore"):
            for i, k in np.argwhere(odd_x):  # only against the cells that are there
                out[i] += np.where(there[k], x[i, k] * y[k], 0)
            for k, j in np.argwhere(odd_y):  # zeros of the left side hide them
                out[:, j] += np.where((x[:, k] != 0) & ~odd_x[:, k], x[:, k] * y[k, j], 0)
        return out

    def each(batches):
        import pyarrow as pa

        for b in batches:
            sums: dict[tuple[int, int], np.ndarray] = {}
            left, right = b.column(2), b.column(3)
            for r, at in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                x, (y, there) = dense(left[r].values)[0], dense(right[r].values)
                sums[at] = sums.get(at, 0) + times(x, y, there)
            values = pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in sums], pa.int64()), pa.array([c for _, c in sums], pa.int64()), values], ["bi", "bj", "cells"])

    return each


def matmul(a: DataFrame, b: DataFrame, side: int = BLOCK) -> DataFrame:
    """The product, all cells present. Zeros of ``a`` are skipped, so they hide infinities of ``b``. Raises where the inner
    sizes differ.

    Both are cut into blocks of ``side`` by ``side`` cells, which meet by their inner row of blocks; a task multiplies pairs of
    them and adds up what belongs to one block of the result, so what is shuffled is blocks, not single products.
    """
    (n, k), (k2, m) = shape(a), shape(b)
    if k != k2:
        raise ValueError(f"inner sizes differ: {k} and {k2}")
    ship(a.sparkSession)
    left, right = _blocks(a, side, ("bi", "bk", "x")), _blocks(b, side, ("bk", "bj", "y"))
    sums = left.join(right, "bk").select("bi", "bj", "x", "y").mapInArrow(_product(side), "bi long, bj long, cells array<double>")
    cells = sums.select("bi", "bj", F.posexplode("cells").alias("p", "v"))
    cells = cells.select((F.col("bi") * side + F.expr(f"p div {side}")).alias("i"), (F.col("bj") * side + F.col("p") % side).alias("j"), "v").filter((F.col("i") < n) & (F.col("j") < m))
    return cells.unionAll(filled(a.sparkSession, n, m)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def matvec(m: DataFrame, v: DataFrame) -> DataFrame:
    """(i, v): the matrix times a vector in long form (j, x). Raises where the sizes differ."""
    n = v.agg(F.max("j")).first()[0]
    if shape(m)[1] != (0 if n is None else n + 1):
        raise ValueError("sizes differ")
    return m.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def trace(m: DataFrame) -> DataFrame:
    """One row (trace); raises for a matrix that isn't square."""
    n, k = shape(m)
    if n != k:
        raise ValueError("not square")
    return m.filter(F.col("i") == F.col("j")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def to_text(m: DataFrame) -> DataFrame:
    """One row a matrix row: (i, text), values between brackets."""
    return to_rows(m).select("i", F.concat(F.lit("["), F.array_join(F.transform("values", lambda x: x.cast("string")), ", "), F.lit("]")).alias("text"))


def most_similar(df: DataFrame, query: list[float], k: int, vec: str = "embedding", key: str = KEY, out: str = "similarity") -> DataFrame:
    """The ``k`` vectors of the greatest cosine to ``query``, by an exact scan; ties by key."""
    if k <= 0:
        return df.withColumn(out, F.lit(0.0)).limit(0)
    (v,) = fresh(df, "v")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn(v, linalg.vector(col(vec))).withColumn(out, linalg.cosine(col(v), q)).drop(v)
    return scored.orderBy(col(out).desc(), col(key)).limit(k)
