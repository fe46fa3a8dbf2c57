"""Trajectories against places: visited locations, points of interest, polygons, crossing tracks.

Spatial conditions become equi-joins: on exact coordinates, or on grid cells followed by the exact test. Sides
are broadcast only where Spark's measured size allows it; nothing is cross-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.schema import LAT, LON, ROW, TIME, TRAJ, TrajectoryError, need, ordered


class UnknownPlaceException(TrajectoryError, KeyError):
    """No row of the layer has the name."""


def visited_location(df: DataFrame, layers: DataFrame, name: str, column: str) -> DataFrame:
    """``Visited_{name}``: 1 where a point has exactly the coordinates of a layer row with ``column == name``, else 0."""
    need(df, LAT, LON)
    need(layers, column, LAT, LON)
    places = layers.where(F.col(f"`{column}`") == name)
    if places.select(LAT).isEmpty():
        raise UnknownPlaceException(f"no {column} is {name!r}")
    keys = places.select(F.col(LAT).cast("double").alias("_vla"), F.col(LON).cast("double").alias("_vlo")).distinct().withColumn("_hit", F.lit(1))
    met = df.join(keys, (F.col(LAT) == F.col("_vla")) & (F.col(LON) == F.col("_vlo")), "left")
    return met.withColumn(f"Visited_{name}", F.coalesce("_hit", F.lit(0))).drop("_vla", "_vlo", "_hit")


def visited_poi(df: DataFrame, surroundings: DataFrame, dist_column: str, nearby_threshold: float, cell: float | None = None) -> DataFrame:
    """``Nearby_POI``: whether some surrounding's distance column differs from its distance to the point by at most the
    threshold. Each surrounding is sent to the cells that its outer ring meets, on the grid of its size class; a point is
    joined there only, so wide surroundings do not coarsen the search for small ones. ``cell``: one size in degrees for all
    instead."""
    need(df, LAT, LON)
    need(surroundings, LAT, LON, dist_column)
    df = ordered(df)
    s = surroundings.select(F.col(LAT).cast("double").alias("_sla"), F.col(LON).cast("double").alias("_slo"), F.col(f"`{dist_column}`").cast("double").alias("_sd"))
    s = s.where(F.col("_sla").isNotNull() & F.col("_slo").isNotNull() & (F.col("_sd") >= -float(nearby_threshold))).distinct()
    s = s.withColumn("_class", F.lit(0) if cell else geo.size_class(2 * (F.col("_sd") + float(nearby_threshold)) / 111_000))
    classes = [0] if cell else sorted(r["_class"] for r in s.select("_class").distinct().collect())  # at most geo.CLASSES
    least = cell or geo.LEAST
    box = geo.bounding_box_columns(F.col("_sla"), F.col("_slo"), F.col("_sd") + float(nearby_threshold) + 1e-3)
    cells = s.withColumn("_cell", F.explode(geo.cells_of_class(F.col("_class"), classes, box, least)))
    near = F.abs(F.col("_sd") - geo.haversine(F.col(LAT), F.col(LON), F.col("_sla"), F.col("_slo"))) <= float(nearby_threshold)
    points = df.select(LAT, LON).where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()).distinct().withColumn("_cell", F.explode(geo.cells_of_point(F.col(LAT), F.col(LON), classes, least)))
    hits = points.join(cells, "_cell").where(near).select(F.col(LAT).alias("_hla"), F.col(LON).alias("_hlo")).distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, (F.col(LAT) == F.col("_hla")) & (F.col(LON) == F.col("_hlo")), "left").withColumn("Nearby_POI", F.coalesce("_hit", F.lit(False))).drop("_hla", "_hlo", "_hit")


def trajectories_inside_polygon(df: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Points within a polygon of (lon, lat) vertices; its boundary counts as inside."""
    need(df, LAT, LON)
    return df.where(geo.in_polygon(F.col(LON), F.col(LAT), list(polygon)))


def traj_intersect_inside_polygon(df1: DataFrame, df2: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Points of two tables with equal coordinates in a polygon: ``traj_id_1, DateTime_1, lat, lon, traj_id_2,
    DateTime_2``; times are not compared. A place with n points of one table and m of the other gives n times m rows:
    for large tables see ``shared_places``."""
    a = trajectories_inside_polygon(df1, polygon).select(F.col(TRAJ).alias("traj_id_1"), F.col(TIME).alias("DateTime_1"), LAT, LON)
    b = trajectories_inside_polygon(df2, polygon).select(F.col(TRAJ).alias("traj_id_2"), F.col(TIME).alias("DateTime_2"), LAT, LON)
    return a.join(b, [LAT, LON]).select("traj_id_1", "DateTime_1", LAT, LON, "traj_id_2", "DateTime_2")


def shared_places(df1: DataFrame, df2: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """The same crossings, one row for each place: ``lat, lon, points_1, points_2, trajectories_1, trajectories_2`` of the
    coordinates in the polygon that both tables have. The points at a place are its members; their pairs are not spelt
    out, so the result and the work grow with the points, also where a third of them share one place."""
    both = None
    for i, df in ((1, df1), (2, df2)):
        at = trajectories_inside_polygon(df, polygon).select(LAT, LON, TRAJ)
        # distinct trajectories of a place in two levels, so a crowded place is no single task
        per = at.groupBy(LAT, LON, TRAJ).agg(F.count("*").alias("n")).groupBy(LAT, LON).agg(F.sum("n").alias(f"points_{i}"), F.count(TRAJ).alias(f"trajectories_{i}"))
        both = per if both is None else both.join(per, [LAT, LON])
    return both.select(LAT, LON, "points_1", "points_2", "trajectories_1", "trajectories_2")


def nearest_poi(pois: DataFrame, coords: tuple[float, float], dist_threshold: float, tags: dict[str, object] | None = None, tag_column: str = "tags") -> DataFrame:
    """Rows of a table of places at the least distance from ``coords`` (all ties) within the threshold, with
    ``Distance``. ``tags``: wanted values of a map column; ``True`` for any value, a list for one of several."""
    need(pois, LAT, LON, *([tag_column] if tags else []))
    box = geo.bounding_box_by_radius(*coords, dist_threshold) if abs(coords[0]) < 85 else (-90.0, -180.0, 90.0, 180.0)
    kept = pois.where(geo.in_box(F.col(LAT), F.col(LON), box)) if -180 <= box[1] and box[3] <= 180 else pois
    for key, value in (tags or {}).items():
        if not isinstance(key, str) or not (value is True or isinstance(value, (str, list, tuple))):
            raise ValueError(f"bad tag {key!r}: {value!r}")
        at = F.col(tag_column)[key]
        kept = kept.where(at.isNotNull() if value is True else at.isin(*([value] if isinstance(value, str) else value)))
    measured = kept.withColumn("Distance", geo.haversine(coords[0], coords[1], F.col(LAT), F.col(LON))).where(F.col("Distance") <= float(dist_threshold))
    least = measured.agg(F.min("Distance").alias("_least"))  # one row
    return measured.join(F.broadcast(least), F.col("Distance") == F.col("_least")).drop("_least")


def herd_candidates(df: DataFrame, polygon: list[tuple[float, float]], threshold_s: float) -> DataFrame:
    """Pairs of different trajectories at equal coordinates in a polygon at most ``threshold_s`` seconds apart.

    Joined on coordinates and time buckets of the threshold (own and next), so candidates stay local in time.
    """
    width = max(int(threshold_s * 1_000_000), 1)
    inside = trajectories_inside_polygon(ordered(df), polygon).select(TRAJ, TIME, LAT, LON, ROW, F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(TIME)).alias("_u"))
    bucket = F.floor(F.col("_u") / width)
    a = inside.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("a")
    b = inside.withColumn("_b", bucket).alias("b")
    met = a.join(b, (F.col("a.lat") == F.col("b.lat")) & (F.col("a.lon") == F.col("b.lon")) & (F.col("a._b") == F.col("b._b")))
    met = met.where((F.col("a.traj_id") < F.col("b.traj_id")) & (F.abs(F.col("a._u") - F.col("b._u")) <= threshold_s * 1e6))
    return met.select(F.col("a.traj_id").alias("traj_id_1"), F.col("a.DateTime").alias("DateTime_1"), F.col("a.lat").alias(LAT), F.col("a.lon").alias(LON), F.col("b.traj_id").alias("traj_id_2"), F.col("b.DateTime").alias("DateTime_2"))
