"""Spatial queries over collections of points and polygons, and their joins.

Points are two top-level numeric columns; documents in which one is null are in no result. Boxes are closed. A limit of
0 or less means no limit, except for ``k``, where it means no result. Ties in distance are broken by the key. Box
conditions are plain comparisons of the raw columns and come first, so they reach the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.skew import col, crowded, fits, fresh, spread_join
from .access import KEY


def _points(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.filter(col(lon).isNotNull() & col(lat).isNotNull())


def _limited(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """In order; a plain top-k where there is a limit."""
    df = df.orderBy(*order)
    return df.limit(limit) if limit > 0 else df


def find_in_box(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, limit: int = 0, lon: str = "lon", lat: str = "lat", key: str = KEY) -> DataFrame:
    """Documents in the box; with a limit those of the least keys."""
    found = df.filter(geo.in_box(col(lon), col(lat), min_x, min_y, max_x, max_y))
    return _limited(found, limit, col(key)) if limit > 0 else found


def _distance(metric: str, x: Column, y: Column, lon: geo.Number, lat: geo.Number) -> Column:
    return {"planar": geo.planar, "geographic": geo.haversine}[metric](x, y, lon, lat)


def find_nearest(
    df: DataFrame, x: float, y: float, k: int, metric: str = "planar", most: float | None = None, lon: str = "lon", lat: str = "lat", key: str = KEY, out: str = "distance"
) -> DataFrame:
    """The ``k`` nearest documents, ascending, with ``out``: degrees for 'planar', metres for 'geographic'.

    Exact everywhere, poles and antimeridian included. ``most`` is a closed bound on the distance; a negative one is met by
    none.
    """
    if k <= 0:
        return df.withColumn(out, F.lit(0.0)).limit(0)
    found = _points(df, lon, lat).withColumn(out, _distance(metric, col(lon), col(lat), x, y))
    if most is not None:
        found = found.filter(col(out) <= most)
    return found.orderBy(col(out), col(key)).limit(k)


def find_nearest_within(df: DataFrame, x: float, y: float, most: float, limit: int = 0, metric: str = "planar", lon: str = "lon", lat: str = "lat", key: str = KEY, out: str = "distance") -> DataFrame:
    """All documents at a distance of at most ``most``, ascending."""
    found = _points(df, lon, lat).withColumn(out, _distance(metric, col(lon), col(lat), x, y)).filter(col(out) <= most)
    return _limited(found, limit, col(out), col(key))


def find_within_radius(df: DataFrame, x: float, y: float, meters: float, limit: int = 0, exact: bool = False, lon: str = "lon", lat: str = "lat", key: str = KEY, out: str = "distance") -> DataFrame:
    """Documents within ``meters`` by great circle, nearest first.

    By default also within the radius's box of degrees, which is a little narrower than the circle (0.11 % in latitude)
    and does not wrap at the antimeridian; ``exact`` drops the box.
    """
    found = _points(df, lon, lat)
    if not exact:
        b = geo.radius_box(x, y, meters)
        found = found.filter((col(lon) >= b["min_x"]) & (col(lon) <= b["max_x"]) & (col(lat) >= b["min_y"]) & (col(lat) <= b["max_y"]))
    found = found.withColumn(out, geo.haversine(x, y, col(lon), col(lat))).filter(col(out) <= meters)
    return _limited(found, limit, col(out), col(key))


def write_places(df: DataFrame, path: str, files: int | None = None, lon: str = "lon", lat: str = "lat", mode: str = "overwrite") -> None:
    """Store places so that boxes prune files and row groups: by ranges of an order
    in which near places have near values, and in it within a file."""
    (z,) = fresh(df, "z")
    placed = df.withColumn(z, geo.morton(col(lon).cast("double"), col(lat).cast("double")))
    placed = placed.repartitionByRange(files, z) if files else placed.repartitionByRange(z)
    placed.sortWithinPartitions(z).drop(z).write.mode(mode).parquet(path)


# -- polygons ----------------------------------------------------------------------------------------------------------
def with_polygons(df: DataFrame, shape: str = "shape", polygon: str = "polygon", box: str = "box") -> DataFrame:
    """Documents whose ``shape`` (ARRAY<ARRAY<DOUBLE>>) is a polygon, with it and its box; the others are left out."""
    df = df.withColumn(polygon, geo.read_polygon(col(shape)))
    return df.filter(col(polygon).isNotNull()).withColumn(box, geo.polygon_box(col(polygon)))


def find_polygons_containing(df: DataFrame, x: float, y: float, limit: int = 0, polygon: str = "polygon", box: str = "box", key: str = KEY) -> DataFrame:
    b = col(box)
    found = df.filter((b["min_x"] <= x) & (b["max_x"] >= x) & (b["min_y"] <= y) & (b["max_y"] >= y) & geo.in_polygon(x, y, col(polygon)))
    return _limited(found, limit, col(key)) if limit > 0 else found


def find_polygons_meeting(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, limit: int = 0, box: str = "box", key: str = KEY) -> DataFrame:
    """Polygons whose box meets the box; their outlines aren't looked at."""
    found = df.filter(geo.boxes_meet(col(box), geo.box(min_x, min_y, max_x, max_y)))
    return _limited(found, limit, col(key)) if limit > 0 else found


def find_points_in_polygon(df: DataFrame, vertices: list[tuple[float, float]], limit: int = 0, lon: str = "lon", lat: str = "lat", key: str = KEY) -> DataFrame:
    """Points inside a literal polygon; none for fewer than three vertices."""
    if len(vertices) < 3:
        return df.limit(0)
    xs, ys = zip(*vertices)
    p = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in vertices])
    found = df.filter(geo.in_box(col(lon), col(lat), min(xs), min(ys), max(xs), max(ys)) & geo.in_polygon(col(lon), col(lat), p))
    return _limited(found, limit, col(key)) if limit > 0 else found


# -- joins -------------------------------------------------------------------------------------------------------------
def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size).cast("long")


#: Grids that polygons may choose: their cells are 2 ** n degrees wide, n from the first to the second.
GRIDS = (-16, 16)


def _grid_of(b: Column) -> Column:
    """The grid for a box: its cells are at most as wide as the box, and more than half of that."""
    wide = F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"], F.lit(1e-9))
    return F.greatest(F.least(F.floor(F.log2(wide)), F.lit(GRIDS[1])), F.lit(GRIDS[0])).cast("int")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float | None = None, lon: str = "lon", lat: str = "lat", polygon: str = "polygon", box: str = "box") -> DataFrame:
    """Each pair of a point and a polygon that holds it, with the columns of both.

    A polygon is laid into the cells that its box meets of a grid whose cells are about as wide as the box: nine at most,
    however large it is. A point lies in one cell of each grid that is in use, of which there are few. The join is by equal
    cell, the exact test follows, and no pair comes twice. Polygons of a checked small size are broadcast; else cells crowded
    with points or with polygons are split. ``cell`` sets one width for all; polygons much larger than it then lie in many cells.
    """
    level, mine, theirs, number, x, y = fresh([points, polygons], "level", "mine", "theirs", "number", "x", "y")
    b = col(box)
    used = polygons.filter(~geo.box_empty(b)).withColumn(level, F.lit(0) if cell else _grid_of(b))
    wide = F.lit(float(cell)) if cell else F.pow(F.lit(2.0), col(level))
    spread = used.withColumn(x, F.explode(F.sequence(_cell(b["min_x"], wide), _cell(b["max_x"], wide))))
    spread = spread.withColumn(y, F.explode(F.sequence(_cell(b["min_y"], wide), _cell(b["max_y"], wide))))
    spread = spread.withColumn(theirs, F.struct(level, x, y)).drop(level, x, y)
    levels = [r[0] for r in used.select(level).distinct().collect()]  # one a grid
    width = lambda n: F.lit(float(cell) if cell else 2.0**n)
    grids = F.array(*[F.struct(F.lit(n).alias(level), _cell(col(lon), width(n)).alias(x), _cell(col(lat), width(n)).alias(y)) for n in levels or [0]])
    placed = _points(points, lon, lat).withColumn(mine, F.explode(grids))
    if fits(spread):
        pairs = placed.join(F.broadcast(spread), col(mine) == col(theirs))
    else:
        # Equal cells have equal numbers; the exact comparison sorts out the rest.
        placed, spread = placed.withColumn(number, F.xxhash64(mine)), spread.withColumn(number, F.xxhash64(theirs))
        pairs = spread_join(placed, spread, number, F.struct(col(lon), col(lat), F.monotonically_increasing_id()), F.struct(b, col(polygon)), crowded(placed, number), crowded(spread, number)).filter(col(mine) == col(theirs)).drop(number)
    inside = geo.in_box(col(lon), col(lat), b["min_x"], b["min_y"], b["max_x"], b["max_y"]) & geo.in_polygon(col(lon), col(lat), col(polygon))
    return pairs.filter(inside).drop(mine, theirs)


def union_box(df: DataFrame, box: str = "box") -> DataFrame:
    """One row: the least box around all boxes that aren't empty, and its area; an empty one for none."""
    b = col(box)
    inf = float("inf")
    used = df.filter(~geo.box_empty(b))
    ends = used.agg(*[F.coalesce(f(b[c]), F.lit(d)).alias(c) for f, c, d in ((F.min, "min_x", inf), (F.min, "min_y", inf), (F.max, "max_x", -inf), (F.max, "max_y", -inf))])
    return ends.withColumn("area", geo.box_area(geo.box(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])))
