"""Rasters: a grid of cells over a box, row 0 in the north, and stacks of them through time.

A mesh is held by a ``Grid`` (what the manifest says) and its cells: long rows (row, col, channel, value), or one array
of all values, row by row, the channels of a cell side by side. A stack has rows (ts_ms, row, col, channel, value,
append_seq), stored by tile.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from . import series


@dataclass(frozen=True)
class Grid:
    min_x: float
    min_y: float
    max_x: float
    max_y: float
    rows: int
    cols: int
    channels: int = 1
    labels: tuple[str, ...] = field(default=())
    tile_size: int = 64
    chunk_size: int = 64

    def __post_init__(self):
        if self.labels and len(self.labels) != self.channels:
            raise ValueError("as many labels as channels, or none")

    def channel_index(self, label: str) -> int:
        """-1 if there is no such label."""
        return self.labels.index(label) if label in self.labels else -1

    def check_channel(self, channel: int) -> None:
        if not 0 <= channel < self.channels:
            raise IndexError(f"no channel {channel}")

    def cell_at(self, x: Column, y: Column) -> Column:
        """STRUCT<row, col> of the cell that holds the point, null outside. The far edges belong to the last cells."""
        w, h = self.max_x - self.min_x, self.max_y - self.min_y
        if w <= 0 or h <= 0 or not self.rows or not self.cols:
            return F.lit(None).cast("struct<row:int,col:int>")
        inside = (x >= self.min_x) & (x <= self.max_x) & (y >= self.min_y) & (y <= self.max_y)
        row = F.least(F.floor((F.lit(self.max_y) - y) / h * self.rows), F.lit(self.rows - 1)).cast("int")
        c = F.least(F.floor((x - F.lit(self.min_x)) / w * self.cols), F.lit(self.cols - 1)).cast("int")
        return F.when(inside, F.struct(row.alias("row"), c.alias("col")))

    def cell_of(self, x: float, y: float) -> tuple[int, int] | None:
        """As ``cell_at``, for one point."""
        w, h = self.max_x - self.min_x, self.max_y - self.min_y
        if w <= 0 or h <= 0 or not (self.min_x <= x <= self.max_x and self.min_y <= y <= self.max_y):
            return None
        return min(int((self.max_y - y) / h * self.rows), self.rows - 1), min(int((x - self.min_x) / w * self.cols), self.cols - 1)

    def cell_center(self, row: Column, c: Column) -> Column:
        """STRUCT<x, y>."""
        w, h = self.max_x - self.min_x, self.max_y - self.min_y
        return F.struct((F.lit(self.min_x) + (c + 0.5) * (w / self.cols)).alias("x"), (F.lit(self.max_y) - (row + 0.5) * (h / self.rows)).alias("y"))

    def tile_dims(self) -> tuple[int, int]:
        """Rows and columns of tiles."""
        return -(-self.rows // self.tile_size), -(-self.cols // self.tile_size)

    def tile_extent(self, tile_r: int, tile_c: int) -> tuple[int, int]:
        """Rows and columns of cells of a tile; those at the far edges may be smaller."""
        return min(self.tile_size, self.rows - tile_r * self.tile_size), min(self.tile_size, self.cols - tile_c * self.tile_size)

    def cells(self, base: DataFrame, row: str = "row", c: str = "col", channel: str = "channel") -> DataFrame:
        """Each row of ``base`` with every cell of the grid."""
        n = self.rows * self.cols * self.channels
        cells = base.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else base.withColumn("_n", F.lit(0)).limit(0)
        per = self.cols * self.channels
        return cells.withColumns({row: F.expr(f"_n div {max(per, 1)}").cast("int"), c: F.expr(f"(_n % {max(per, 1)}) div {self.channels}").cast("int"), channel: (F.col("_n") % self.channels).cast("int")}).drop("_n")


# -- meshes ------------------------------------------------------------------------------------------------------------
def mesh(spark: SparkSession, grid: Grid, value: float = 0.0) -> DataFrame:
    """The cells of a mesh filled with one value."""
    return grid.cells(spark.range(1).drop("id")).withColumn("value", F.lit(float(value)))


def value_at(points: DataFrame, cells: DataFrame, grid: Grid, channel: int = 0, x: str = "lon", y: str = "lat", out: str = "value") -> DataFrame:
    """``points`` with ``out``, the value of the cell each lies in; NaN outside. Raises for a channel that isn't there."""
    grid.check_channel(channel)
    at = points.withColumn("_at", grid.cell_at(F.col(x), F.col(y)))
    one = cells.filter(F.col("channel") == channel).select(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).alias("_at"), F.col("value").alias("_value"))
    return at.join(one, "_at", "left").withColumn(out, F.coalesce("_value", F.lit(float("nan")))).drop("_at", "_value")


def vector_at(data: Column, grid: Grid, x: Column, y: Column) -> Column:
    """All channels of the cell that holds the point, from a mesh in one array; empty outside."""
    at = grid.cell_at(x, y)
    base = (at["row"] * grid.cols + at["col"]) * grid.channels
    return F.when(at.isNull(), F.array().cast("array<double>")).otherwise(F.slice(data, base + 1, grid.channels))


def set_cell(cells: DataFrame, row: int, c: int, channel: int, value: float) -> DataFrame:
    here = (F.col("row") == row) & (F.col("col") == c) & (F.col("channel") == channel)
    return cells.withColumn("value", F.when(here, F.lit(float(value))).otherwise(F.col("value")))


@F.arrow_udf(T.BinaryType())
def pack(s: pa.Array) -> pa.Array:
    """ARRAY<DOUBLE> as little-endian 64-bit floats; a null inside is a NaN."""
    n = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = pc.fill_null(s.flatten(), np.nan).to_numpy(zero_copy_only=False).astype("<f8").tobytes()
    ends = pa.array(np.concatenate(([0], np.cumsum(n) * 8)), pa.int64())
    packed = pa.Array.from_buffers(pa.large_binary(), len(s), [None, ends.buffers()[1], pa.py_buffer(raw)])
    return pc.if_else(s.is_valid(), packed, pa.scalar(None, pa.large_binary())).cast(pa.binary())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unpack(s: pa.Array) -> pa.Array:
    """Little-endian 64-bit floats as ARRAY<DOUBLE>; null where the length doesn't fit."""
    n = pc.fill_null(pc.binary_length(s), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = (n >= 0) & (n % 8 == 0)
    values = np.frombuffer(b"".join(s.filter(pa.array(ok)).to_pylist()), "<f8")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(ok, n // 8, 0)))), pa.int32()), pa.array(values, pa.float64()))
    return pc.if_else(pa.array(ok), lists, pa.scalar(None, lists.type))


def to_document(data: Column, grid: Grid) -> Column:
    """A mesh as the value of a document's field."""
    box = F.array(*[F.lit(float(v)) for v in (grid.min_x, grid.min_y, grid.max_x, grid.max_y)])
    return F.struct(
        box.alias("bbox"), F.lit(grid.rows).cast("long").alias("rows"), F.lit(grid.cols).cast("long").alias("cols"), F.lit(grid.channels).cast("long").alias("channels"),
        F.array(*[F.lit(x) for x in grid.labels]).cast("array<string>").alias("labels"), pack(data).alias("data"),
    )


def read_document(doc: Column) -> Column:
    """The values of a mesh in a document as ARRAY<DOUBLE>; null if box, sizes, labels and data don't go together."""
    n = doc["rows"] * doc["cols"] * doc["channels"]
    ok = (F.size(doc["bbox"]) == 4) & (doc["rows"] >= 0) & (doc["cols"] >= 0) & (doc["channels"] >= 1) & (F.octet_length(doc["data"]) == n * 8)
    ok = ok & (F.size(F.coalesce(doc["labels"], F.array().cast("array<string>"))).isin(0) | (F.size(doc["labels"]) == doc["channels"]))
    return F.when(F.coalesce(ok, F.lit(False)), unpack(doc["data"]))


# -- stacks ------------------------------------------------------------------------------------------------------------
def create_stack(spark: SparkSession, root: str, grid: Grid) -> None:
    if shared.exists(spark, f"{root}/manifest.json"):
        raise FileExistsError(root)
    shared.write_text(spark, f"{root}/manifest.json", json.dumps(asdict(grid)))


def open_stack(spark: SparkSession, root: str) -> tuple[Grid, DataFrame | None]:
    """The grid, and the rows stored so far (null before the first)."""
    got = json.loads(shared.read_text(spark, f"{root}/manifest.json"))
    at = f"{root}/cells"
    return Grid(**got | {"labels": tuple(got["labels"])}), spark.read.parquet(at) if shared.exists(spark, at) else None


def with_tiles(frames: DataFrame, grid: Grid) -> DataFrame:
    return frames.withColumns({"tile_r": F.expr(f"row div {grid.tile_size}").cast("int"), "tile_c": F.expr(f"col div {grid.tile_size}").cast("int")})


def append_frames(root: str, frames: DataFrame, grid: Grid) -> None:
    """Append whole frames, stored by tile and in order of time within a file; a tile with many frames is written by many
    tasks. Cells outside the grid raise."""
    bad = ~(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1) & F.col("channel").between(0, grid.channels - 1))
    checked = frames.withColumn("value", F.when(bad, F.raise_error(F.lit("a cell outside the grid")).cast("double")).otherwise(F.col("value")))
    tiled = with_tiles(checked, grid).repartitionByRange("tile_r", "tile_c", "ts_ms").sortWithinPartitions("tile_r", "tile_c", "ts_ms")
    tiled.write.mode("append").partitionBy("tile_r", "tile_c").parquet(f"{root}/cells")


def _first(rows: DataFrame) -> DataFrame:
    """Of cells that several frames of one time give, the one appended first."""
    return rows.groupBy("ts_ms", "row", "col", "channel").agg(F.min_by("value", "append_seq").alias("value"))


def read_frames(frames: DataFrame, grid: Grid, low: int, high: int) -> DataFrame:
    """(ts_ms, row, col, channel, value): the whole frame of every time from low to high that has one, by time. Cells
    without a value are 0."""
    used = frames.filter((F.col("ts_ms") >= low) & (F.col("ts_ms") <= high))
    place = [F.col(c).cast("int").alias(c) for c in ("row", "col", "channel")]
    # A 0 after all that was appended stands for what is absent: one aggregation instead of a join with the whole grid.
    last = F.lit((1 << 63) - 1)
    full = grid.cells(used.select("ts_ms").distinct()).select("ts_ms", *place, F.lit(0.0).alias("value"), last.alias("append_seq"))
    both = used.select("ts_ms", *place, F.col("value").cast("double").alias("value"), F.coalesce(F.col("append_seq").cast("long"), last - 1).alias("append_seq")).unionAll(full)
    return _first(both).withColumn("value", F.coalesce("value", F.lit(0.0))).orderBy("ts_ms", "row", "col", "channel")


def read_frame(frames: DataFrame, grid: Grid, ts: int) -> DataFrame:
    """The frame of exactly that time; no rows if there is none."""
    return read_frames(frames, grid, ts, ts)


def point_history(frames: DataFrame, grid: Grid, x: float, y: float, low: int, high: int, channel: int = 0) -> DataFrame:
    """(ts_ms, value) of one cell from low to high by time; all frames of a time, in the order they were appended. None
    outside the grid; raises for a channel that isn't there."""
    grid.check_channel(channel)
    cell = grid.cell_of(x, y)
    if cell is None:
        return frames.select("ts_ms", "value").limit(0)
    used = frames.filter((F.col("row") == cell[0]) & (F.col("col") == cell[1]) & (F.col("channel") == channel) & (F.col("ts_ms") >= low) & (F.col("ts_ms") <= high))
    if "tile_r" in frames.columns:
        used = used.filter((F.col("tile_r") == cell[0] // grid.tile_size) & (F.col("tile_c") == cell[1] // grid.tile_size))
    return used.orderBy("ts_ms", "append_seq").select("ts_ms", "value")


def with_chunks(frames: DataFrame, grid: Grid) -> DataFrame:
    """``frames`` by tile, with ``seg`` and ``part`` that name the chunk of a frame within its tile: a time before the last
    one starts a new segment, and a segment is cut every ``chunk_size`` frames."""
    tiled = with_tiles(frames, grid)
    tile = F.concat_ws(",", "tile_r", "tile_c")
    once = tiled.groupBy("tile_r", "tile_c", "ts_ms", "append_seq").agg(F.lit(0.0).alias("value")).withColumn("series_id", tile)
    named = series.with_blocks(once, grid.chunk_size).select("tile_r", "tile_c", "append_seq", "ts_ms", "seg", "part")
    return tiled.join(named, ["tile_r", "tile_c", "append_seq", "ts_ms"])


def chunk_counts(frames: DataFrame, grid: Grid) -> DataFrame:
    """(tile_r, tile_c, chunks, active): full or closed chunks of each tile, and the frames of its last one while it isn't full."""
    c = F.col
    by = with_chunks(frames, grid).groupBy("tile_r", "tile_c", "seg", "part").agg(F.countDistinct("append_seq", "ts_ms").alias("n"))
    last = by.groupBy("tile_r", "tile_c").agg(F.max_by("n", F.struct("seg", "part")).alias("n"), F.count(F.lit(1)).alias("all"))
    open_ = c("n") < grid.chunk_size
    return last.select("tile_r", "tile_c", F.when(open_, c("all") - 1).otherwise(c("all")).alias("chunks"), F.when(open_, c("n")).otherwise(F.lit(0)).cast("long").alias("active"))


def latest_ts(frames: DataFrame) -> DataFrame:
    """One row (ts_ms), over all tiles; null without frames."""
    return frames.agg(F.max("ts_ms").alias("ts_ms"))
