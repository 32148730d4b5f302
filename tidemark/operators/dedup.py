"""Messages delivered more than once: exactly one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import same_id
from ..plans.skew import HOT_ROWS, HOT_SHARE, col, fresh
from ..sources.shared import written

#: Parts in which every group is ranked before its parts' first rows are.
SALTS = 64


def mark_copies(
    stored: DataFrame,
    new: DataFrame | None = None,
    *,
    ids: tuple[str, ...] = ("change_id", "origin_node"),
    order: str = "seq",
    out: str = "is_copy",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All deliveries, stored and new, with a BOOLEAN ``out``: true for every one but the first of its message.

    A message is what has the same ``ids``, without regard to case and blanks at the ends. The first is the one with
    the smallest ``order``, a null before all; of equal ones any single one is taken. A delivery whose first id is null
    or empty belongs to no message and is never a copy; a null in a later id is a value like others. Extra columns pass
    through; ``new`` is matched by name and may lack columns.

    Identifiers are counted with map-side aggregation. Those that occur once pass directly; only the groups of the
    others are ranked, every one of them in salted parts and then among the parts' first rows, so no task orders a whole
    large group. Identifiers with more than ``hot_rows`` rows and one HOT_SHARE-th of all, of which there can't be more
    than HOT_SHARE, are told apart by broadcast, so that no join by identifier meets them.
    """
    df = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already")
    *keys, n, salt, rank = fresh(df.withColumn(out, F.lit(1)), *(f"id{i}" for i in range(len(ids))), "n", "salt", "rank")
    keyed = df.withColumns({k: same_id(col(c).cast("string")) if i == 0 else F.coalesce(same_id(col(c).cast("string")), F.lit("\0")) for i, (k, c) in enumerate(zip(keys, ids))})
    told = F.coalesce(F.length(col(keys[0])) > 0, F.lit(False))

    counts = keyed.filter(told).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    repeated = written(counts.filter(col(n) > 1), "repeated-ids")
    total, most = repeated.agg(F.sum(n), F.max(n)).first()
    bound = max(hot_rows, (total or 0) // HOT_SHARE)

    rows = keyed.filter(told)
    parts = [keyed.filter(~told).withColumn(out, F.lit(False))]
    if (most or 0) > bound:
        hot = F.broadcast(repeated.filter(col(n) > bound).select(*keys))  # HOT_SHARE rows at most
        parts.append(_ranked(rows.join(hot, keys, "left_semi"), keys, order, salt, rank, out))
        rows = rows.join(hot, keys, "left_anti")
    again = repeated.filter(col(n) <= bound).select(*keys)
    parts.append(rows.join(again, keys, "left_anti").withColumn(out, F.lit(False)))
    parts.append(_ranked(rows.join(again, keys, "left_semi"), keys, order, salt, rank, out))
    result = parts[0].select(*[col(c) for c in [*df.columns, out]])
    for p in parts[1:]:
        result = result.unionAll(p.select(*[col(c) for c in [*df.columns, out]]))
    return result


def _ranked(rows: DataFrame, keys: list[str], order: str, salt: str, rank: str, out: str) -> DataFrame:
    """Rank groups of any size: each in SALTS parts by a hash of the order, then the parts' first rows among themselves."""
    first: Column = col(order).asc_nulls_first()
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(col(order)), F.lit(SALTS)))
    local = salted.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(first)))
    beaten = local.filter(col(rank) > 1).withColumn(out, F.lit(True))
    led = local.filter(col(rank) == 1).withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(first)))
    return beaten.unionAll(led.withColumn(out, col(rank) > 1))


def drop_copies(stored: DataFrame, new: DataFrame | None = None, **options) -> DataFrame:
    """Exactly one row of each message, and every row that has no identifier. See ``mark_copies``."""
    (out,) = fresh(stored if new is None else stored.unionByName(new, allowMissingColumns=True), "is_copy")
    return mark_copies(stored, new, out=out, **options).filter(~col(out)).drop(out)
