"""Joins of many query points with many points: the k nearest of each, and all within a distance of each.

Space is cut into cells of bounded population, in the plane or, for great-circle distances, in the cube around the unit sphere
(where the chord orders points as the arc does, with neither poles nor antimeridian). Every point is counted, in cells that
are halved in each direction until they hold no more than POPULATION points, or so many that there are no more than about
CELLS cells, whose table is what the driver and the tasks hold of the data. From it each query gets a radius that surely
holds k points, and the cells that its ball meets; queries and points then meet by equal cell, so what a query is held
against grows with the population of a cell, not with the data. Cells that hold many points nevertheless (of one place, say)
or that many queries ask for are split by salt, so no task gets more than its share of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.skew import col, crowded, fits, fresh, spread_join
from ..session import ship
from ..sources.shared import written

#: Points of a cell, and a bound on the number of cells: with more than POPULATION * CELLS / 2 points cells hold more.
POPULATION, CELLS = 32, 1 << 20
#: Halvings of each direction that are counted at first, and at most, by the number of directions.
FIRST, DEEPEST = {2: 10, 3: 8}, {2: 26, 3: 18}
#: Bits of a coordinate in the number of a cell.
BITS = {2: 29, 3: 19}
#: A cell with more than this share of the points, or of what the queries ask, is split, into SPLIT parts at most; no more
#: than 1 / SHARE cells can be.
SHARE, SPLIT = 0.001, 64
#: Room for rounding in cell borders and radii.
ROOM = 1e-9


def _coordinates(metric: str, x: Column, y: Column) -> list[Column]:
    if metric == "planar":
        return [x.cast("double"), y.cast("double")]
    lon, lat = F.radians(x), F.radians(y)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


class Cells:
    """The tree of cells as the tasks get it: the numbers of its nodes in order, their counts, and which are leaves."""

    def __init__(self, low: np.ndarray, size: np.ndarray, counted: list[tuple[int, np.ndarray, np.ndarray]], most: float):
        """``counted``: for each level that was counted its cells, as coordinates (n, d), and their counts; cells that were
        counted again deeper are in the deeper level only."""
        self.low, self.size, self.d = low, size, len(low)
        given = {lv: (xy, n) for lv, xy, n in counted if len(n)}
        at: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by level: numbers, counts, whether there are children
        deepest = max(given, default=0)
        xy, n = np.zeros((0, self.d), np.int64), np.zeros(0, np.int64)
        for level in range(deepest, -1, -1):
            parents = np.ones(len(n), bool)
            if level in given:
                xy, n = np.concatenate([xy, given[level][0]]), np.concatenate([n, given[level][1]])
                parents = np.concatenate([parents, np.zeros(len(given[level][1]), bool)])
            numbers = self.number(level, xy)
            order = np.argsort(numbers)
            at[level] = numbers[order], n[order], parents[order]
            if level:
                up, back = np.unique(xy >> 1, axis=0, return_inverse=True)
                n, xy = np.bincount(back.ravel(), n, len(up)).astype(np.int64), up
        kept, keep = [], np.ones(len(at[0][0]), bool)
        for level in range(deepest + 1):
            numbers, n, inner = at[level]
            numbers, n, inner = numbers[keep], n[keep], inner[keep] & (n[keep] > most)
            kept.append((numbers, n, ~inner))
            if level < deepest:
                above = self.number(level, self.split(level + 1, at[level + 1][0]) >> 1)
                keep = np.isin(above, numbers[inner])
        self.numbers, self.counts, self.leaf = (np.concatenate(x) for x in zip(*kept))
        self.total = int(at[0][1].sum())

    def number(self, level, xy: np.ndarray) -> np.ndarray:
        b = BITS[self.d]
        out = np.asarray(level, np.int64) << (b * self.d)
        for a in range(self.d):
            out = out | xy[:, a] << (b * (self.d - 1 - a))
        return out

    def split(self, level, numbers: np.ndarray) -> np.ndarray:
        b = BITS[self.d]
        return np.stack([numbers >> (b * (self.d - 1 - a)) & ((1 << b) - 1) for a in range(self.d)], 1)

    def levels(self) -> list[int]:
        return sorted({int(x) for x in np.unique(self.numbers[self.leaf] >> (BITS[self.d] * self.d))})

    def met(self, p: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, leaves, radii): the leaves, by place in ``numbers``, that each ball meets. With ``k`` above 0 the radii,
        infinite at first, are narrowed to what surely holds k points, level by level."""
        q, node = np.arange(len(p)), np.zeros(len(p), np.int64)
        r = r.astype(float).copy()
        if not self.total:
            return q[:0], node[:0], r
        while True:
            level = self.numbers[node] >> (BITS[self.d] * self.d)
            width = self.size / np.exp2(level)[:, None]
            low = self.low + self.split(level, self.numbers[node]) * width
            x = p[q]
            near = np.sqrt((np.maximum(np.maximum(low - x, x - low - width), 0) ** 2).sum(1))
            if k:
                far = np.sqrt((np.maximum(np.abs(x - low), np.abs(low + width - x)) ** 2).sum(1))
                order = np.lexsort((far, q))
                held = np.cumsum(self.counts[node[order]])
                first = np.searchsorted(q[order], np.arange(len(p)))  # every query keeps the node that holds its nearest
                before = np.concatenate(([0], held))[first][q[order]]
                enough = np.flatnonzero(held - before >= k)
                have, at = np.unique(q[order][enough], return_index=True)
                r[have] = np.minimum(r[have], far[order][enough[at]])
            keep = near <= r[q] * (1 + ROOM) + ROOM
            q, node = q[keep], node[keep]
            done = self.leaf[node]
            if done.all():
                return q, node, r
            inner, owner = node[~done], q[~done]
            level = (self.numbers[inner] >> (BITS[self.d] * self.d)) + 1
            xy = self.split(level, self.numbers[inner]) << 1
            grown_q, grown = [q[done]], [node[done]]
            for corner in range(1 << self.d):
                numbers = self.number(level, xy + [corner >> a & 1 for a in range(self.d)])
                place = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
                there = self.numbers[place] == numbers
                grown_q.append(owner[there])
                grown.append(place[there])
            q, node = np.concatenate(grown_q), np.concatenate(grown)


def _number(level: int, coordinates: list[Column], low: np.ndarray, size: np.ndarray) -> Column:
    """As ``Cells.number`` of the cell that a point lies in."""
    d, side = len(coordinates), 1 << level
    out = F.lit(level << (BITS[d] * d)).cast("long")
    for a, c in enumerate(coordinates):
        step = F.greatest(F.least(F.floor((c - float(low[a])) / float(size[a] / side)).cast("long"), F.lit(side - 1)), F.lit(0))
        out = out.bitwiseOR(F.shiftleft(step.cast("long"), BITS[d] * (d - 1 - a)))
    return out


def cells(points: DataFrame, coordinates: list[Column], metric: str) -> Cells:
    """Count all points: once to FIRST halvings, and those of cells that hold too many again to as many more as the bound on
    cells allows, until none does or halving ends. What is collected is cells, some 4 * CELLS at most."""
    d = len(coordinates)
    if metric == "planar":
        ends = points.agg(*[f(c) for c in coordinates for f in (F.min, F.max)]).first()
        low, high = (np.array([ends[2 * i + j] or 0.0 for i in range(d)], float) for j in (0, 1))
    else:
        low, high = np.full(d, -1.0), np.full(d, 1.0)
    size = np.maximum((high - low) * (1 + 1e-12), 1e-9)
    level, some, counted, total = FIRST[d], points, [], None
    while True:
        got = some.groupBy(_number(level, coordinates, low, size).alias("c")).count().toPandas()
        numbers, n = got["c"].to_numpy(np.int64), got["count"].to_numpy(np.int64)
        xy = np.stack([numbers >> (BITS[d] * (d - 1 - a)) & ((1 << BITS[d]) - 1) for a in range(d)], 1)
        total = int(n.sum()) if total is None else total
        most = max(POPULATION, 2 * total / CELLS)
        full = n > most
        room = next((b for b in range(5, 0, -1) if full.sum() << d * b <= 4 * CELLS and level + b <= DEEPEST[d]), 0)
        if not full.any() or not room:
            counted.append((level, xy, n))
            return Cells(low, size, counted, most)
        counted.append((level, xy[~full], n[~full]))
        again = points.sparkSession.createDataFrame(pd.DataFrame({"__c": numbers[full]}))
        some = points.join(F.broadcast(again), _number(level, coordinates, low, size) == F.col("__c"), "left_semi")
        level += room


def _finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        c = col(n).cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def asked_cells(queries: DataFrame, grid: Cells, k: int, at: list[str], r: str, cell: str) -> DataFrame:
    """``queries``, one row a cell that they meet, with ``cell`` and the radius in ``r``; ``r`` below 0 meets none."""
    sent = queries.sparkSession.sparkContext.broadcast(grid)
    names = queries.columns

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                radius = np.full(len(part), np.inf) if k else part[r].to_numpy(float)
                use = np.flatnonzero(radius >= 0)
                q, leaf, found = g.met(part[at].to_numpy(float)[use], radius[use], k)
                order = np.argsort(q, kind="stable")
                out = part.iloc[use[q[order]]].copy()
                out[r], out[cell] = found[q[order]] * (1 + ROOM) + ROOM, g.numbers[leaf[order]]
                yield out[[*names, cell]]

    return queries.mapInPandas(spread, queries.withColumn(cell, F.lit(0).cast("long")).schema)


def _join(queries: DataFrame, points: DataFrame, metric: str, k: int, reach: Column | None, q: tuple[str, str], p: tuple[str, str], key: str, out: str) -> DataFrame:
    spark = points.sparkSession
    ship(spark)
    for c in (out, "rank"):
        if c in queries.columns or c in points.columns:
            raise ValueError(f"there is a column {c} already")
    both = [queries, points]
    cell, r, *names = fresh(both, "cell", "r", *(f"{s}{i}" for s in "ab" for i in range(3)))
    d = 2 if metric == "planar" else 3
    at, own = names[:d], names[3 : 3 + d]
    points = points.filter(_finite(*p))
    queries = queries.filter(_finite(*q))
    there = _coordinates(metric, col(p[0]), col(p[1]))
    grid = cells(points, there, metric)

    queries = queries.withColumns({**dict(zip(at, _coordinates(metric, col(q[0]), col(q[1])))), r: F.lit(-1.0) if reach is None else reach.cast("double")})
    # Work on queries is Python's, and far more than moving them: spread over all cores, however few files they come from.
    queries = queries.repartition(2 * spark.sparkContext.defaultParallelism, *map(col, q))
    asked = asked_cells(queries, grid, k, at, r, cell)

    # A point's leaf is at one of the levels that have leaves; the table of leaves, some CELLS at most, tells at which.
    levels = grid.levels()
    placed = points.withColumns(dict(zip(own, there)))
    if len(levels) > 1:
        leaves = spark.createDataFrame(pd.DataFrame({"__leaf": grid.numbers[grid.leaf]}))
        tries = F.explode(F.array(*[_number(lv, there, grid.low, grid.size) for lv in levels]))
        placed = placed.withColumn(cell, tries).join(F.broadcast(leaves), col(cell) == F.col("__leaf"), "left_semi")
    else:
        placed = placed.withColumn(cell, _number(levels[0] if levels else 0, there, grid.low, grid.size))

    straight = F.lit(0.0)
    for a, b in zip(at, own):
        straight = straight + (col(a) - col(b)) * (col(a) - col(b))
    if fits(placed):
        pairs = asked.join(F.broadcast(placed), cell)
    else:
        asked = written(asked, "asked")
        most = max(1, grid.total * SHARE)
        full = {int(c): min(SPLIT, int(-(-n // most))) for c, n in zip(grid.numbers[grid.leaf], grid.counts[grid.leaf]) if n > most}
        pairs = spread_join(asked, placed, cell, F.struct(*map(col, [*at, *queries.columns[:1]])), col(key), crowded(asked, cell, SHARE), full)
    distance = geo.planar if metric == "planar" else geo.haversine
    near = pairs.filter(straight <= col(r) * col(r)).drop(cell, r, *at, *own)
    return near.withColumn(out, distance(col(q[0]), col(q[1]), col(p[0]), col(p[1])))


def nearest_join(
    queries: DataFrame, points: DataFrame, k: int, metric: str = "planar", query_key: str = "query_id", x: str = "qx", y: str = "qy", lon: str = "lon", lat: str = "lat", key: str = "doc_id", out: str = "distance"
) -> DataFrame:
    """The ``k`` nearest points of each query, with ``out`` (degrees or metres) and ``rank``; ties by ``key``.

    Exact. ``query_key`` names a query; points and queries without coordinates take no part; a query has fewer than k if
    there are fewer points, and none for k of 0 or less. Column names of both sides must differ.
    """
    if k <= 0:
        k, keep = 1, F.lit(False)
    else:
        keep = F.col("rank") <= k
    near = _join(queries, points, metric, k, None, (x, y), (lon, lat), key, out)
    rank = F.row_number().over(Window.partitionBy(col(query_key)).orderBy(col(out), col(key)))
    return near.withColumn("rank", rank).filter(keep)


def radius_join(
    queries: DataFrame, points: DataFrame, within: float | Column, metric: str = "geographic", x: str = "qx", y: str = "qy", lon: str = "lon", lat: str = "lat", key: str = "doc_id", out: str = "distance"
) -> DataFrame:
    """Each pair of a query and a point at most ``within`` (degrees or metres, a number or a column of the queries) apart."""
    most = within if isinstance(within, Column) else F.lit(float(within))
    (name,) = fresh([queries, points], "most")
    arc = F.least(F.greatest(col(name), F.lit(0.0)) / (2 * geo.EARTH_RADIUS_M), F.lit(np.pi / 2).cast("double"))
    reach = F.when(col(name) < 0, -1.0).otherwise(col(name) if metric == "planar" else 2 * F.sin(arc))
    near = _join(queries.withColumn(name, most), points, metric, 0, reach, (x, y), (lon, lat), key, out)
    return near.filter(col(out) <= col(name)).drop(name)
