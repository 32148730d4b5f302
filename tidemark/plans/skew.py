"""Joins and names that stay safe under skew, nulls and clashing columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: A lookup side is broadcast only if its rows, at the width of its schema, take no more than this.
BROADCAST_BYTES = 16 << 20
#: A key is hot if it has more rows than HOT_ROWS and than one HOT_SHARE-th of all: no more than HOT_SHARE keys can be.
HOT_ROWS, HOT_SHARE = 50_000, 10_000
#: Parts into which every key of the large side is split otherwise.
SALTS = 16


def fresh(df: DataFrame | list[DataFrame], *bases: str) -> list[str]:
    """Column names that ``df``, or none of a list of them, has, in any letter case."""
    taken = {c.lower() for d in (df if isinstance(df, list) else [df]) for c in d.columns}
    out = []
    for b in bases:
        name, n = f"_{b}", 0
        while name.lower() in taken:
            n += 1
            name = f"_{b}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_bytes(schema: T.StructType) -> int:
    """Bytes of a row as a rough upper guess by type; strings count as 64."""

    def one(t: T.DataType) -> int:
        if isinstance(t, T.StructType):
            return 8 + sum(one(f.dataType) for f in t)
        if isinstance(t, (T.ArrayType, T.MapType)):
            return 512
        return 64 if isinstance(t, (T.StringType, T.BinaryType)) else 8

    return 16 + sum(one(f.dataType) for f in schema)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to broadcast, by counting its rows (no further than needed)."""
    most = limit // row_bytes(df.schema)
    return df.limit(most + 1).count() <= most


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot values of ``keys``, HOT_SHARE at most whatever the data, or null for none. Counted with map-side aggregation."""
    (n,) = fresh(df, "n")
    counts = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(n))
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    bound = max(rows, (total or 0) // HOT_SHARE)
    return written(counts.filter(col(n) > bound).drop(n), "hot-keys") if (most or 0) > bound else None  # usually there are none


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join each row of ``big`` with its row of ``small`` (unique in ``on``).

    A ``small`` of a checked size is broadcast. A larger one is joined by
    shuffle on the key and a salt taken from ``spread``, with ``small`` repeated
    once a salt, so a key with a third of all rows is met by SALTS tasks.
    """
    if fits(small, limit):
        return big.join(F.broadcast(small), on, how)
    (salt,) = fresh([big, small], "salt")
    left = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def crowded(df: DataFrame, on: str, share: float = 0.001, least: int = 1000) -> dict:
    """The values of ``on`` that more than a ``share`` of all rows have (and more than ``least``), and into how many parts, of
    that size each, they are to be split. No more than 1 / share values."""
    counts = df.groupBy(col(on)).agg(F.count(F.lit(1)).alias("n"))
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    most = max((total or 0) * share, least)
    return {r[0]: min(64, int(-(-r[1] // most))) for r in counts.filter(F.col("n") > most).collect()} if (top or 0) > most else {}


def spread_join(left: DataFrame, right: DataFrame, on: str, by_left: Column, by_right: Column, left_parts: dict, right_parts: dict) -> DataFrame:
    """The inner join on ``on``, values crowded on either side being split: each is a rectangle of parts, rows of ``left``
    lying in one part by ``by_left`` and in every one of ``right``, and the other way round."""
    if not left_parts and not right_parts:
        return left.join(right, on)
    spark = left.sparkSession
    a, b, n, m = fresh([left, right], "a", "b", "n", "m")
    kind = dict(left.dtypes)[on]
    parts = F.broadcast(spark.createDataFrame([(c, left_parts.get(c, 1), right_parts.get(c, 1)) for c in {*left_parts, *right_parts}], f"`{on}` {kind}, `{n}` int, `{m}` int"))
    one, every = lambda x: F.coalesce(col(x), F.lit(1)), lambda x: F.explode(F.sequence(F.lit(0), F.coalesce(col(x), F.lit(1)) - 1))
    left = left.join(parts, on, "left").withColumns({a: F.pmod(F.xxhash64(by_left), one(n)).cast("int"), b: every(m)}).drop(n, m)
    right = right.join(parts, on, "left").withColumns({a: every(n), b: F.pmod(F.xxhash64(by_right), one(m)).cast("int")}).drop(n, m)
    return left.join(right, [on, a, b]).drop(a, b)


def by_heat(df: DataFrame, keys: list[str], most: int, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(rows, hot)`` over the rows of hot keys, which have more than ``most`` rows and which it must do in chunks, and
    over those of all others, which a window by key takes at once. Without hot keys, which is usual, all rows are scanned
    and shuffled once by it, after their keys were counted."""
    if not keys:
        return work(df, df.limit(most + 1).count() > most)
    hot = hot_keys(df, keys, most)
    if hot is None:
        return work(df, False)
    names = fresh(df, *(f"hot{i}" for i in range(len(keys))))
    same = [col(k).eqNullSafe(col(n)) for k, n in zip(keys, names)]
    told = F.broadcast(hot.toDF(*names))
    return work(df.join(told, same, "left_anti"), False).unionByName(work(df.join(told, same, "left_semi"), True))


def in_chunks(df: DataFrame, keys: list[str], order: str, size: int, hot: bool = True) -> tuple[DataFrame, str, str]:
    """``df`` without rows that lack ``order``, with two columns, whose names come with it: the keys as one struct, in which
    nulls are equal, and the chunk of ``size`` values of ``order`` (a whole number) that a row lies in; of rows that aren't
    ``hot`` there is one chunk.

    Ordered work over groups of any size goes chunk by chunk: windows by both columns, a summary of each chunk, and
    ``carried`` to bring what came before into a chunk.
    """
    key, chunk = fresh(df, "key", "chunk")
    struct = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    df = df.filter(col(order).isNotNull())
    return df.withColumns({key: struct, chunk: F.expr(f"`{order}` div {size}") if hot else F.lit(0).cast("long")}), key, chunk


def carry(rows: DataFrame, summary: DataFrame, key: str, chunk: str) -> DataFrame:
    """``rows`` with the columns that ``summary``, one row a chunk, has besides ``key`` and ``chunk``."""
    k, c = fresh([rows, summary], "k", "c")
    short = summary.withColumnsRenamed({key: k, chunk: c})
    return rows.join(short, (col(key) == col(k)) & (col(chunk) == col(c))).drop(k, c)


def carried(rows: DataFrame, key: str, chunk: str, summary: Column, out: str, how: str = "last", hot: bool = True) -> DataFrame:
    """``rows`` with ``out``: what the chunks of the same key before this one add up to ('last', 'max' or 'sum'); null where
    there are none, as in rows that aren't ``hot``."""
    (s,) = fresh(rows, "s")
    if not hot:
        return rows.withColumn(out, F.lit(None).cast(rows.agg(summary.alias(s)).schema[0].dataType))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    f = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}[how]
    short = rows.groupBy(key, chunk).agg(summary.alias(s)).withColumn(out, f(col(s)).over(before)).drop(s)
    return carry(rows, short, key, chunk)
