"""Geometry as Column expressions: boxes, great circles, polygons. All boxes are closed and never wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean radius of the earth in metres, and metres per degree of latitude used for boxes.
EARTH_RADIUS_M, METERS_PER_DEGREE = 6371008.8, 111320.0
#: Fixed value: below this cosine of the latitude a box spans all longitudes.
POLE_COSINE = 1e-9

Number = Column | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def point(x: Number, y: Number) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


# -- boxes: STRUCT<min_x, min_y, max_x, max_y>, empty if a minimum is above its maximum ------------------------------
def box(min_x: Number, min_y: Number, max_x: Number, max_y: Number) -> Column:
    return F.struct(_c(min_x).alias("min_x"), _c(min_y).alias("min_y"), _c(max_x).alias("max_x"), _c(max_y).alias("max_y"))


def box_empty(b: Column) -> Column:
    return (b["min_x"] > b["max_x"]) | (b["min_y"] > b["max_y"])


def box_area(b: Column) -> Column:
    """0 for an empty box."""
    return F.when(box_empty(b), 0.0).otherwise((b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"]))


def box_union(a: Column, b: Column) -> Column:
    """The least box around both; an empty one adds nothing."""
    both = box(F.least(a["min_x"], b["min_x"]), F.least(a["min_y"], b["min_y"]), F.greatest(a["max_x"], b["max_x"]), F.greatest(a["max_y"], b["max_y"]))
    return F.when(box_empty(a), b).when(box_empty(b), a).otherwise(both)


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def in_box(x: Column, y: Column, min_x: Number, min_y: Number, max_x: Number, max_y: Number) -> Column:
    return (x >= _c(min_x)) & (x <= _c(max_x)) & (y >= _c(min_y)) & (y <= _c(max_y))


def _outside(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - v, F.lit(0.0), v - hi)


def box_distance(x: Number, y: Number, b: Column) -> Column:
    """Planar distance to the box, 0 inside."""
    return F.sqrt(box_distance_sq(x, y, b))


def box_distance_sq(x: Number, y: Number, b: Column) -> Column:
    """The square of ``box_distance``."""
    dx, dy = _outside(_c(x), b["min_x"], b["max_x"]), _outside(_c(y), b["min_y"], b["max_y"])
    return dx * dx + dy * dy


def _spread_bits(v: Column) -> Column:
    """The 16 low bits of a BIGINT, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(lon: Column, lat: Column) -> Column:
    """A BIGINT in which points that are near have near values: 16 bits of each degree, in turn. Null for a null."""
    step = lambda v, low, width: F.least(F.greatest(F.floor((v - low) / width * 65536), F.lit(0)), F.lit(65535)).cast("long")
    return _spread_bits(step(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread_bits(step(lat, -90.0, 180.0)), 1))


# -- distances -------------------------------------------------------------------------------------------------------
def planar(x1: Number, y1: Number, x2: Number, y2: Number) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def haversine(lon1: Number, lat1: Number, lon2: Number, lat2: Number) -> Column:
    """Great-circle metres."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    s, t = F.sin((a2 - a1) / 2), F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2)
    h = s * s + F.cos(a1) * F.cos(a2) * t * t
    return 2.0 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1.0 - h)))


def haversine_to_box(lon: Number, lat: Number, b: Column) -> Column:
    """Great-circle metres to the point of the box that is nearest in degrees; 0 inside."""
    near_x = F.least(F.greatest(_c(lon), b["min_x"]), b["max_x"])
    near_y = F.least(F.greatest(_c(lat), b["min_y"]), b["max_y"])
    return haversine(lon, lat, near_x, near_y)


def radius_box(lon: Number, lat: Number, meters: Number) -> Column:
    """The box of degrees that stands for a radius: by METERS_PER_DEGREE in latitude, wider in longitude by the cosine."""
    d = _c(meters) / METERS_PER_DEGREE
    cos = F.abs(F.cos(F.radians(_c(lat))))
    w = F.when(cos < POLE_COSINE, 180.0).otherwise(d / cos)
    return box(_c(lon) - w, _c(lat) - d, _c(lon) + w, _c(lat) + d)


# -- polygons: ARRAY<STRUCT<x, y>>, the last vertex joined to the first ------------------------------------------------
def read_polygon(shape: Column) -> Column:
    """The polygon of an ARRAY<ARRAY<DOUBLE>>: at least three vertices of at least two numbers each, else null; further
    numbers of a vertex are ignored."""
    ok = (F.size(shape) >= 3) & F.forall(shape, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(shape, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))))


def polygon_box(p: Column) -> Column:
    """The least box; an empty one for a polygon without vertices."""
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    inf = float("inf")
    return box(F.coalesce(F.array_min(xs), F.lit(inf)), F.coalesce(F.array_min(ys), F.lit(inf)), F.coalesce(F.array_max(xs), F.lit(-inf)), F.coalesce(F.array_max(ys), F.lit(-inf)))


def in_polygon(x: Number, y: Number, p: Column) -> Column:
    """Even-odd rule; false below three vertices. Whether a point on an edge is inside is left open."""
    x, y = _c(x), _c(y)
    before = F.concat(F.slice(p, -1, 1), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))))

    def crosses(a: Column, b: Column) -> Column:
        rises = (a["y"] > y) != (b["y"] > y)
        return F.when(rises, x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(F.lit(False))

    odd = F.aggregate(F.zip_with(p, before, crosses), F.lit(False), lambda s, e: s != e)
    return F.when(F.size(p) < 3, F.lit(False)).otherwise(odd)
