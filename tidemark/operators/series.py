"""Time series as rows (series_id, append_seq, ts_ms, value).

Order is the order of appending, not of time: ranges and latest values come in it, and a time that goes back starts a new
block. ``append_seq`` is unique within a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import by_heat, carried, carry, in_chunks

#: Samples of a block, and the span of append_seq in which ordered work is done at a time.
BLOCK, CHUNK = 4096, 1 << 16
KEY = ["series_id"]


def append(df: DataFrame, path: str) -> None:
    """Append rows to the stored table, by ranges of series and order, so that both prune files and row groups and a long
    series is written by many tasks."""
    df.repartitionByRange("series_id", "append_seq").sortWithinPartitions("series_id", "append_seq").write.mode("append").parquet(path)


def one(df: DataFrame, series_id: object) -> DataFrame:
    return df.filter(F.col("series_id") == F.lit(series_id))


def in_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """Samples with low <= ts_ms <= high in append order; none if low is above high."""
    return df.filter((F.col("ts_ms") >= low) & (F.col("ts_ms") <= high)).orderBy("series_id", "append_seq")


def latest(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` samples by append order, oldest first. For one series, or over all of them as one."""
    if n <= 0:
        return df.limit(0)
    return df.orderBy(F.col("append_seq").desc()).limit(n).orderBy("append_seq")


def latest_each(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` samples of each series. Each task keeps n a series before the shuffle."""
    if n <= 0:
        return df.limit(0)
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("append_seq").desc()))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def items(df: DataFrame) -> DataFrame:
    return df.orderBy("series_id", "append_seq")


def stats(df: DataFrame) -> DataFrame:
    """(series_id, samples, first_ts, last_ts): by append order, so not the least and greatest times where these go back."""
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("samples"), F.min_by("ts_ms", "append_seq").alias("first_ts"), F.max_by("ts_ms", "append_seq").alias("last_ts"))


def with_blocks(df: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``seg`` and ``part``, which name a sample's block: a time before the last one starts a new segment, and a
    segment is cut every ``block`` samples.

    Long series are worked on chunk by chunk of append_seq, with the segment and its length carried over.
    """
    return by_heat(df, KEY, chunk, lambda rows, hot: _with_blocks(rows, block, chunk, hot))


def _with_blocks(df: DataFrame, block: int, chunk: int, hot: bool) -> DataFrame:
    c = F.col
    rows, key, chunk_ = in_chunks(df, KEY, "append_seq", chunk, hot)
    here = Window.partitionBy(key, chunk_).orderBy("append_seq")
    rows = carried(rows, key, chunk_, F.max_by("ts_ms", "append_seq"), "_prev_ts", hot=hot)
    prev = F.coalesce(F.lag("ts_ms").over(here), c("_prev_ts"))
    rows = rows.withColumn("_back", F.coalesce((c("ts_ms") < prev).cast("int"), F.lit(0))).withColumn("_seg", F.sum("_back").over(here))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, chunk_, "_seg").orderBy("append_seq")))
    if not hot:
        return rows.withColumns({"seg": c("_seg"), "part": F.floor((c("_at") - 1) / block)}).drop(key, chunk_, "_prev_ts", "_back", "_seg", "_at")
    # Of each chunk: its breaks, and the samples since the last of them, which are in the segment that stays open.
    s = rows.groupBy(key, chunk_).agg(F.max("_seg").alias("breaks"), F.max_by("_at", "append_seq").alias("n"))
    order = Window.partitionBy(key).orderBy(chunk_)
    s = s.withColumns({"_segs": F.coalesce(F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "g": F.sum((c("breaks") > 0).cast("int")).over(order)})
    s = s.withColumn("open", F.sum("n").over(Window.partitionBy(key, "g").orderBy(chunk_)))
    s = s.withColumn("_open", F.coalesce(F.lag("open").over(order), F.lit(0))).drop("breaks", "n", "g", "open")
    rows = carry(rows, s, key, chunk_)
    at = c("_at") + F.when(c("_seg") == 0, c("_open")).otherwise(0)
    rows = rows.withColumns({"seg": c("_seg") + c("_segs"), "part": F.floor((at - 1) / block)})
    return rows.drop(key, chunk_, "_prev_ts", "_back", "_seg", "_at", "_segs", "_open")


def block_stats(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block: (series_id, seg, part, samples, start_ts, end_ts, min_val, max_val)."""
    by = with_blocks(df, block).groupBy("series_id", "seg", "part")
    return by.agg(
        F.count(F.lit(1)).alias("samples"), F.min_by("ts_ms", "append_seq").alias("start_ts"), F.max_by("ts_ms", "append_seq").alias("end_ts"),
        F.min("value").alias("min_val"), F.max("value").alias("max_val"),
    )


def drop_blocks_before(df: DataFrame, cutoff: int, block: int = BLOCK) -> DataFrame:
    """Without the full or closed blocks that end before ``cutoff``. A block that reaches it stays whole, and so does the
    last block of a series while it isn't full."""
    c = F.col
    rows = with_blocks(df, block)
    b = rows.groupBy("series_id", "seg", "part").agg(F.max_by("ts_ms", "append_seq").alias("end_ts"), F.count(F.lit(1)).alias("n"))
    last = Window.partitionBy("series_id").orderBy(c("seg").desc(), c("part").desc())
    open_ = (F.row_number().over(last) == 1) & (c("n") < block)
    gone = b.withColumn("open", open_).filter((c("end_ts") < cutoff) & ~c("open"))
    gone = gone.select(c("series_id").alias("_s"), c("seg").alias("_g"), c("part").alias("_p"))
    return rows.join(gone, c("series_id").eqNullSafe(c("_s")) & (c("seg") == c("_g")) & (c("part") == c("_p")), "left_anti").drop("seg", "part")
