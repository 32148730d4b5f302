"""Apply a feed of puts and deletes, repeated and out of order, and read the documents alive in the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import op_kind, same_id
from ..sources import shared
from ..sources.vectors import VectorTable

#: Batches in which a whole log is applied.
BATCHES = 3
KEYS = ["collection", "doc_id"]
ORDER = ["clocked", "wall", "counter", "node", "told", "seq"]


def images(changes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The changes as images. A change without a clock is older than any with it; of deliveries of one clock, one with an
    identifier is taken first, then the latest. Rows whose ``op`` is neither put nor delete are left out."""
    h = F.col("hlc")
    cid = same_id(F.col("change_id"))
    return changes.select(
        *KEYS, h.isNotNull().alias("clocked"), h["wall"].alias("wall"), h["counter"].alias("counter"), h["node"].alias("node"),
        F.coalesce(F.length(cid) > 0, F.lit(False)).alias("told"), "seq", op_kind(F.col("op")).alias("op"), "version", cid.alias("change_id"), *extra,
    ).filter(F.col("op").isNotNull())


def table(spark, root: str | None = None) -> VectorTable:
    return VectorTable(spark, root or shared.fresh_folder(spark, "feed"), KEYS, ORDER)


def apply_feed(changes: DataFrame, root: str | None = None, batches: int = BATCHES, extra: tuple[str, ...] = ()) -> VectorTable:
    """Apply a whole log in arrival order in ``batches`` parts of about equal ranges of ``seq`` (a null seq comes first)."""
    spark = changes.sparkSession
    t = table(spark, root)
    lo, hi = changes.agg(F.min("seq"), F.max("seq")).first()
    cuts = [None, None] if lo is None else [None, *[lo + (hi - lo) * i // batches for i in range(1, batches)], None]
    for a, b in zip(cuts, cuts[1:]):
        part = changes
        if a is not None:
            part = part.filter(F.col("seq") > a)
        if b is not None:
            part = part.filter((F.col("seq") <= b) | F.col("seq").isNull()) if a is None else part.filter(F.col("seq") <= b)
        t.apply(images(part, extra))
    return t


def alive(t: VectorTable) -> DataFrame:
    """(collection, doc_id, op, version, change_id, hlc, ...) of the documents whose newest image is a put."""
    rows = t.read().filter(F.col("op") == "put")
    clock = F.when(F.col("clocked"), F.struct("wall", "counter", "node"))
    rest = [c for c in rows.columns if c not in {*KEYS, *ORDER, "op", "version", "change_id"}]
    return rows.select(*KEYS, "op", "version", "change_id", clock.alias("hlc"), *rest)
