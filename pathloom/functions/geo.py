"""Geographic column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def number(name: str) -> Column:
    """A numeric column as double with NaN as null."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres; null if any coordinate is null."""
    p1, l1, p2, l2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    a = F.when(a > 1.0, 1.0).otherwise(a)  # unlike least(), null stays null
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * 1000.0


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 up to (not including) 360; 0 between equal points."""
    p1, l1, p2, l2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(l2 - l1) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(l2 - l1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bounding_box_by_radius(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """``(min_lat, min_lon, max_lat, max_lon)`` of a circle around a point."""
    r = radius_m / (EARTH_KM * 1000)
    d = math.degrees(math.asin(math.sin(r) / math.cos(math.radians(lat))))
    return lat - math.degrees(r), lon - d, lat + math.degrees(r), lon + d


def bounding_box_columns(lat, lon, radius_m) -> tuple[Column, Column, Column, Column]:
    """The same per row; where the circle reaches a pole the box spans all longitudes."""
    r = _c(radius_m) / (EARTH_KM * 1000)
    d_lat = F.degrees(r)
    ratio = F.sin(r) / F.greatest(F.cos(F.radians(_c(lat))), F.lit(1e-12))
    d_lon = F.when((ratio < 1) & (F.abs(_c(lat)) + d_lat < 90), F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).otherwise(F.lit(180.0))
    return _c(lat) - d_lat, _c(lon) - d_lon, _c(lat) + d_lat, _c(lon) + d_lon


def nsew_to_degrees(value: Column, *, longitude: bool) -> Column:
    """``28.0N``, ``94.8W`` as signed degrees; a western value beyond 180 wraps to the east. Null for other texts."""
    number = F.substring(value, 1, F.length(value) - 1).try_cast("double")
    side = F.right(value, F.lit(1))
    if not longitude:
        return F.when(side == "N", number).otherwise(-number)
    west = F.when(-number < -180, 360 - number).otherwise(-number)
    return F.when(side == "E", number).otherwise(west)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return (lat >= box[0]) & (lon >= box[1]) & (lat <= box[2]) & (lon <= box[3])


def in_polygon(lon: Column, lat: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of (lon, lat) vertices, its boundary included.

    Ray casting as one expression over literal edges, behind a box test that reaches the scan.
    """
    edges = list(zip(polygon, polygon[1:] + polygon[:1]))
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in edges:
        cross = (F.lit(x2 - x1) * (lat - y1)) - (F.lit(y2 - y1) * (lon - x1))
        between = lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
        on_edge = on_edge | ((cross == 0) & between)
        if y1 != y2:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit((x2 - x1) / (y2 - y1)) * (lat - y1) + x1)
            crossings = crossings + hit.cast("int")
    inside = on_edge | (crossings % 2 == 1)
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & inside


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web Mercator metres (x, y)."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def _columns(cell: float) -> tuple[int, float]:
    """Columns of a grid around the globe and their width, at least ``cell``: whole columns only, so that both sides of
    the 180th meridian count alike."""
    turn = max(math.floor(360 / cell), 1)
    return turn, 360 / turn


def grid_cells(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, cell: float) -> Column:
    """The cells ``struct(cy, cx)`` of a grid of ``cell`` degrees that a box meets; longitudes wrap around."""
    turn, wide = _columns(cell)
    rows = F.sequence(F.floor(F.greatest(min_lat, F.lit(-90.0)) / cell), F.floor(F.least(max_lat, F.lit(90.0)) / cell))
    from_x, to_x = F.floor(min_lon / wide), F.floor(max_lon / wide)
    cols = F.array_distinct(F.transform(F.sequence(from_x, F.least(to_x, from_x + turn)), lambda i: F.pmod(i, F.lit(turn))))
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(y.cast("int").alias("cy"), x.cast("int").alias("cx")))))


def grid_cell(lat: Column, lon: Column, cell: float) -> Column:
    turn, wide = _columns(cell)
    return F.struct(F.floor(lat / cell).cast("int").alias("cy"), F.pmod(F.floor(lon / wide), F.lit(turn)).cast("int").alias("cx"))


def cell_for(widest: float | None, parts: int = 8) -> float:
    """A cell size at which a box of at most ``widest`` degrees meets some ``parts`` cells a side."""
    return min(max((widest or 0.0) / parts, 0.01), 45.0)


CLASSES, LEAST = 13, 0.01  # cell sizes 0.01, 0.02, ... 40.96 degrees


def size_class(width: Column, parts: int = 8) -> Column:
    """Which of ``CLASSES`` cell sizes suits a box of that many degrees: it meets at most about ``parts`` cells a side, so
    a single wide box does not coarsen the grid of all others."""
    c = F.ceil(F.log2(F.greatest(width, F.lit(1e-9)) / (LEAST * parts)))
    return F.least(F.greatest(c, F.lit(0)), F.lit(CLASSES - 1)).cast("int")


def _classed(cls: int, cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(cls).alias("cls"), c["cy"].alias("cy"), c["cx"].alias("cx")))


def cells_of_class(cls: Column, classes: list[int], box: tuple[Column, Column, Column, Column], least: float = LEAST) -> Column:
    """The cells ``struct(cls, cy, cx)`` that a box meets on the grid of its class."""
    return F.coalesce(*(F.when(cls == c, _classed(c, grid_cells(*box, least * 2**c))) for c in classes), F.array().cast("array<struct<cls:int,cy:int,cx:int>>"))


def cells_of_point(lat: Column, lon: Column, classes: list[int], least: float = LEAST) -> Column:
    """The cell of a point on the grid of each class that occurs."""
    return F.flatten(F.array(*(_classed(c, F.array(grid_cell(lat, lon, least * 2**c))) for c in classes), F.array().cast("array<struct<cls:int,cy:int,cx:int>>")))
