"""Reads of a collection: by id, by equal values, by an ordered range.

A collection is a DataFrame with a key column, ``doc_id`` by default. Everything here is a filter, a join with a list of
ids or a top-k, so predicates reach the files and Catalyst picks the plan. A limit of 0 or less means no limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.values import LETTERS, kind_of_literal, kind_of_type
from ..plans.skew import col, fits, fresh, hot_keys

KEY = "doc_id"


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit) if limit > 0 else df


def get(df: DataFrame, doc_id: object, key: str = KEY) -> DataFrame:
    """The document, or no row."""
    return df.filter(col(key) == F.lit(doc_id))


def get_many(df: DataFrame, ids: Sequence | DataFrame, key: str = KEY, position: str | None = None) -> DataFrame:
    """The documents of a list of ids. Ids without a document are left out; an id that is listed twice gives two rows.

    ``position`` names a column that receives the place of each id in the list, for reads in input order. ``ids`` may be a
    DataFrame with the column ``key``: it is broadcast if its size is checked to be small, and joined by shuffle else; ids
    that are listed very often then meet their documents, which are few, by broadcast.
    """
    if isinstance(ids, DataFrame):
        if fits(ids):
            return df.join(F.broadcast(ids), key)
        hot = hot_keys(ids, [key])
        if hot is None:
            return df.join(ids, key)
        often = df.join(F.broadcast(hot), key, "left_semi")
        rest = df.join(ids.join(F.broadcast(hot), key, "left_anti"), key)
        return rest.unionByName(ids.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(often), key).select(*[col(c) for c in rest.columns]))
    pos = position or fresh(df, "position")[0]
    listed = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"`{pos}` long, `{key}` {dict(df.dtypes)[key]}")
    found = df.join(F.broadcast(listed) if fits(listed) else listed, key)
    return found if position else found.drop(pos)


def get_all(df: DataFrame) -> DataFrame:
    return df


def current_version(df: DataFrame, doc_id: object, key: str = KEY, version: str = "version") -> DataFrame:
    """One row (version): 0 if the document is absent."""
    return get(df, doc_id, key).agg(F.coalesce(F.max(col(version)), F.lit(0)).cast("long").alias("version"))


def field(df: DataFrame, path: str) -> Column:
    """The column at a dotted path; a name that holds the dots itself goes before a path through structs."""
    return col(path) if path in df.columns else F.col(path)


def kind_of(df: DataFrame, path: str) -> str | None:
    return kind_of_type(df.select(field(df, path).alias("x")).dtypes[0][1])


def find_by(df: DataFrame, equal: dict[str, object], limit: int = 0, key: str = KEY) -> DataFrame:
    """Documents of which every path has the given value.

    A value of another kind than the column's matches nothing (1 is not 1.0); null matches null and missing. With a limit
    the documents of the least keys are taken.
    """
    if not equal:
        raise ValueError("no path given")
    cond = F.lit(True)
    for path, v in equal.items():
        k = kind_of_literal(v)
        cond = cond & (field(df, path).isNull() if v is None else field(df, path) == F.lit(v) if k == kind_of(df, path) else F.lit(False))
    found = df.filter(cond)
    return found.orderBy(col(key)).limit(limit) if limit > 0 else found


def range_by(
    df: DataFrame, path: str, low: object = None, high: object = None, *,
    include_low: bool = True, include_high: bool = True, limit: int = 0, ascending: bool = True, key: str = KEY,
) -> DataFrame:
    """Documents whose value at ``path`` lies between the bounds, in its order; ties by ``key``, ascending.

    A null bound is open. Kinds are ordered by their letters, so a bound of another kind than the column's holds for all
    of its values or for none. Null has its place among the kinds: after ints and floats, before strings; an open bound on
    that side includes it, as two open bounds always do.
    """
    k = kind_of(df, path)
    if k is None:
        return df.limit(0)
    c, own, null = field(df, path), LETTERS[k], LETTERS["null"]

    def side(v: object, inclusive: bool, lower: bool) -> tuple[Column, bool]:
        """The condition on values, and whether nulls meet it."""
        if v is None:
            return F.lit(True), True
        letter = LETTERS[kind_of_literal(v)]
        nulls = null > letter if lower else null < letter
        if letter != own:
            return F.lit(own > letter if lower else own < letter), nulls
        x = F.lit(v)
        return ((c >= x if inclusive else c > x) if lower else (c <= x if inclusive else c < x)), nulls

    (a, an), (b, bn) = side(low, include_low, True), side(high, include_high, False)
    cond = c.isNotNull() & a & b
    if an and bn:
        cond = cond | c.isNull()
    nulls_last = (own < null) == ascending
    order = {(True, True): c.asc_nulls_last, (True, False): c.asc_nulls_first, (False, True): c.desc_nulls_last, (False, False): c.desc_nulls_first}
    return _limited(df.filter(cond).orderBy(order[ascending, nulls_last](), col(key)), limit)


def stream(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, for results too large to collect. All of one consistent snapshot."""
    return df.toLocalIterator(prefetchPartitions=True)
