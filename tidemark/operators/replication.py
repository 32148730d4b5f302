"""Exchange of change logs between nodes: export by cursor, last writer wins, clocks and garbage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import hlc_order
from ..plans.skew import by_heat, carried, col, in_chunks
from ..sources import shared
from ..streaming.capture import latest_by

KEYS = ["collection", "doc_id"]
CHUNK = 1 << 20


def export_changes(log: DataFrame, since: int = 0, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Changes after ``since`` that have an identifier, of the included collections (all by default) but the excluded, by seq."""
    rows = log.filter((F.col("seq") > since) & (F.length("change_id") > 0))
    if include:
        rows = rows.filter(F.col("collection").isin(*include))
    if exclude:
        rows = rows.filter(~F.col("collection").isin(*exclude))
    return rows.orderBy("seq")


def export_cursor(log: DataFrame, since: int = 0, **filters) -> DataFrame:
    """One row (cursor): the greatest seq exported, else ``since``."""
    return export_changes(log, since, **filters).agg(F.coalesce(F.max("seq"), F.lit(since)).cast("long").alias("cursor"))


def trace(local: DataFrame, incoming: DataFrame, pos: str = "batch_pos", chunk: int = CHUNK) -> DataFrame:
    """``incoming`` with ``accepted``: what applying the changes one by one in the order of ``pos`` would accept.

    A change is a candidate if no earlier one of its document, the local one first, has a greater clock; a candidate is
    accepted unless its identifier is that of the candidate before. Documents with many changes are worked on by chunks.
    """
    c = F.col
    start = local.select(*KEYS, "change_id", "hlc").withColumns({pos: F.lit(-1).cast("long"), "_new": F.lit(False)})
    both = incoming.withColumn("_new", F.lit(True)).unionByName(start, allowMissingColumns=True).withColumn("_h", hlc_order(c("hlc")))
    return by_heat(both, KEYS, chunk, lambda rows, hot: _traced(rows, pos, chunk, hot))


def _traced(rows: DataFrame, pos: str, chunk: int, hot: bool) -> DataFrame:
    c = F.col
    rows, key, chunk_ = in_chunks(rows, KEYS, pos, chunk, hot)
    earlier = Window.partitionBy(key, chunk_).orderBy(col(pos)).rowsBetween(Window.unboundedPreceding, -1)
    rows = carried(rows, key, chunk_, F.max("_h"), "_before", "max", hot)
    inside = F.max("_h").over(earlier)
    rows = rows.withColumn("_top", F.when(inside.isNull(), c("_before")).when(c("_before").isNull() | (inside > c("_before")), inside).otherwise(c("_before")))
    rows = rows.withColumn("_cand", c("_top").isNull() | (c("_h") >= c("_top")))
    rows = rows.withColumn("_cid", F.when(c("_cand"), F.struct(c("change_id").alias("id"))))
    rows = carried(rows, key, chunk_, F.max_by("_cid", F.when(c("_cand"), col(pos))), "_last", hot=hot)
    last = F.coalesce(F.last("_cid", ignorenulls=True).over(earlier), c("_last"))
    rows = rows.withColumn("accepted", c("_cand") & (last.isNull() | ~c("_cid").eqNullSafe(last)))
    return rows.filter("_new").drop("_new", key, chunk_, "_h", "_before", "_top", "_cand", "_cid", "_last")


def apply_changes(local: DataFrame, incoming: DataFrame, pos: str = "batch_pos") -> DataFrame:
    """The state after applying ``incoming``: of each document the change with the greatest clock, of equal clocks the later.

    The local row comes before all; one without a clock loses to any with it. Deletes stay as rows, so that older puts
    that arrive later find them. Applying the same changes again changes nothing.
    """
    both = incoming.unionByName(local.withColumn(pos, F.lit(-1).cast("long")), allowMissingColumns=True)
    return latest_by(both, KEYS, [hlc_order(F.col("hlc")), col(pos)])


def gc_log(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """The log without what all peers have (seq up to the least cursor); whole if there is no peer or one has nothing."""
    least = cursors.agg(F.min("cursor")).first()[0]
    return log.filter(F.col("seq") > least) if least else log


def set_cursor(cursors: DataFrame, peer: str, seq: int) -> DataFrame:
    row = cursors.sparkSession.createDataFrame([(peer, seq)], "peer string, cursor long")
    return cursors.filter(F.col("peer") != peer).unionByName(row)


def get_cursor(cursors: DataFrame, peer: str) -> int:
    row = cursors.filter(F.col("peer") == peer).agg(F.max("cursor")).first()
    return row[0] or 0


def save_cursors(cursors: DataFrame, path: str) -> None:
    """One small file, there whole or not at all; peers are few."""
    shared.write_text(cursors.sparkSession, path, json.dumps(dict(cursors.groupBy("peer").agg(F.max("cursor")).collect())))


def load_cursors(spark: SparkSession, path: str) -> DataFrame:
    """(peer, cursor); no rows before the first save."""
    got = json.loads(shared.read_text(spark, path)) if shared.exists(spark, path) else {}
    return spark.createDataFrame(list(got.items()), "peer string, cursor long")


def tick(rows: DataFrame, now: str, order: str, node: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with ``hlc`` as one node's clock gives it: the wall is the greatest time so far, the counter the number of
    changes since the wall last grew, less one. ``order`` is a whole number, unique; rows are worked on by chunks of it."""
    return by_heat(rows, [], chunk, lambda part, hot: _ticked(part, now, order, node, chunk, hot))


def _ticked(rows: DataFrame, now: str, order: str, node: str, chunk: int, hot: bool) -> DataFrame:
    c = F.col
    rows, key, chunk_ = in_chunks(rows, [], order, chunk, hot)
    rows = carried(rows, key, chunk_, F.max(col(now)), "_top", "max", hot)
    here = Window.partitionBy(key, chunk_).orderBy(col(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_wall", F.greatest(F.max(col(now)).over(here), c("_top")))
    rows = rows.withColumn("_same", F.struct("_wall"))
    rows = carried(rows, "_same", chunk_, F.count(F.lit(1)), "_earlier", "sum", hot)
    n = F.row_number().over(Window.partitionBy("_same", chunk_).orderBy(col(order))) - 1 + F.coalesce("_earlier", F.lit(0))
    clock = F.struct(c("_wall").cast("long").alias("wall"), n.cast("long").alias("counter"), F.lit(node).alias("node"))
    return rows.withColumn("hlc", clock).drop(key, chunk_, "_top", "_wall", "_same", "_earlier")


def merge_clocks(a: Column, b: Column) -> Column:
    """The greater of two clocks."""
    return F.when(a.isNull() | (hlc_order(b) > hlc_order(a)), b).otherwise(a)
