"""Irregular readings onto a regular grid of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join

#: Periods a chunk holds: the unit in which a series of any length is spread over tasks.
CHUNK = 512


def regular_grid(info: DataFrame, blocks: DataFrame, max_gap: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(series_id, slot_ms, samples, low, high, status): one row for each series and period.

    The periods of a series begin at ``active_from + k * period_ms`` before ``active_to``. A block with a positive
    ``sample_count`` whose ``start_ts`` lies in a period observes it; other blocks fill nothing. Blocks with the same
    (series_id, block_seq) and period count once, with their greatest ``sample_count``. ``samples`` is the sum of the
    counts, ``low`` and ``high`` the least ``min_val`` and greatest ``max_val``; a NaN counts as null there, and its block
    observes its period all the same. ``status`` is 'observed'; 'carried' where the
    last observed period lies at most ``max_gap`` periods back, whose low and high are then repeated (samples 0);
    'missing' elsewhere (low and high null, samples 0). A series whose limits or period are null, or whose period is not
    positive, has no periods; repeated rows of ``info`` count once; blocks of unknown series are left out.

    A series is cut into chunks of ``chunk`` periods. Readings are aggregated by period, then joined to the sequence of
    chunks; the periods are made only after that join, so the grid itself is never shuffled, and no task holds more than
    a chunk of any series.
    """
    if not 0 <= max_gap <= chunk:
        raise ValueError("max_gap must lie between 0 and chunk")
    c = F.col
    series = (
        info.select("series_id", c("period_ms").cast("long").alias("p"), c("active_from").cast("long").alias("f"), c("active_to").cast("long").alias("t"))
        .filter((c("p") > 0) & (c("t") > c("f")) & c("series_id").isNotNull())
        .dropDuplicates()
    )
    used = blocks.filter((c("sample_count") > 0) & c("start_ts").isNotNull()).select("series_id", "block_seq", "start_ts", "sample_count", "min_val", "max_val")
    placed = (
        lookup_join(used, series, ["series_id"], c("block_seq"))
        .filter((c("start_ts") >= c("f")) & (c("start_ts") < c("t")))
        .withColumn("slot", F.expr("(start_ts - f) div p"))
    )
    number = lambda f: F.when(~F.isnan(f), c(f))
    once = placed.groupBy("series_id", "f", "p", "t", "slot", "block_seq").agg(F.max("sample_count").alias("n"), F.min(number("min_val")).alias("lo"), F.max(number("max_val")).alias("hi"))
    by_slot = once.groupBy("series_id", "f", "p", "t", "slot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # A reading near the end of its chunk also goes to the next one, as what is carried in; a chunk gets at most chunk + max_gap.
    here = F.expr(f"slot div {chunk}")
    to = F.when(c("slot") % chunk >= chunk - max_gap, F.array(here, here + 1)).otherwise(F.array(here))
    lists = by_slot.withColumn("chunk", F.explode(to)).groupBy("series_id", "f", "p", "t", "chunk").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "lo", "hi"))).alias("got"))

    count = F.expr("(t - f + p - 1) div p")
    chunks = series.withColumn("slots", count).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {chunk}"))))
    full = chunks.join(lists, ["series_id", "f", "p", "t", "chunk"], "left")
    start, end = c("chunk") * chunk, F.least((c("chunk") + 1) * chunk, c("slots"))
    # Each reading covers the periods up to the next one; a first stretch without a source covers what lies before all.
    none = F.array(F.struct(F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
    got = F.concat(none, F.coalesce("got", F.array().cast("array<struct<slot:bigint,n:bigint,lo:double,hi:double>>")))
    spans = (
        full.withColumns({"start": start, "end": end, "got": got})
        .select("series_id", "f", "p", "start", "end", "got", F.posexplode("got").alias("i", "src"))
        .withColumn("a", F.greatest("start", "src.slot"))
        .withColumn("b", F.least("end", F.expr("try_element_at(got, i + 2).slot")))
        .drop("got")
        .filter(c("a") < c("b"))
    )
    cells = spans.select("series_id", "f", "p", "src", F.explode(F.sequence("a", c("b") - 1)).alias("slot"))
    back = c("slot") - c("src.slot")
    status = F.when(back == 0, "observed").when(back <= max_gap, "carried").otherwise("missing")
    kept = status != "missing"
    return cells.select(
        "series_id",
        (c("f") + c("slot") * c("p")).alias("slot_ms"),
        F.when(back == 0, c("src.n")).otherwise(F.lit(0)).cast("long").alias("samples"),
        F.when(kept, c("src.lo")).alias("low"),
        F.when(kept, c("src.hi")).alias("high"),
        status.alias("status"),
    )


def missing_periods(info: DataFrame, blocks: DataFrame, **options) -> DataFrame:
    """(series_id, slot_ms) of every period without a block of its own, whether or not a value is carried into it."""
    return regular_grid(info, blocks, **options).filter(F.col("status") != "observed").select("series_id", "slot_ms")
