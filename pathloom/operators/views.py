"""The data behind the usual maps and dashboard charts (drawing is left to a plotting library)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators.aggregates import distance_travelled
from pathloom.operators.temporal import PARTS, part_of_day
from pathloom.schema import LAT, LON, ROW, TIME, TRAJ, need, ordered

# Species by code and by the letter in an animal's id.
SPECIES_CODES = {0: "Deer", 1: "Elk", 2: "Cattle"}


def species_of_id(traj_id: Column) -> Column:
    return F.when(traj_id.contains("D"), "Deer").when(traj_id.contains("E"), "Elk").otherwise("Cattle")


def species_of_code(code: Column) -> Column:
    return F.when(code == 0, "Deer").when(code == 1, "Elk").when(code == 2, "Cattle")


def trajectory_distance_treemap(df: DataFrame) -> DataFrame:
    """``traj_id, Distance, days, daily_distance, Species``: metres per whole day of a trajectory's duration (null below
    one day)."""
    span = df.groupBy(TRAJ).agg(F.min(TIME).alias("a"), F.max(TIME).alias("z"))
    days = F.floor(F.timestamp_diff("MICROSECOND", F.col("a"), F.col("z")) / F.lit(86400e6)).cast("int")
    table = distance_travelled(df).join(span.select(TRAJ, days.alias("days")), TRAJ)
    return table.select(TRAJ, "Distance", "days", F.try_divide("Distance", "days").alias("daily_distance"), species_of_id(F.col(TRAJ)).alias("Species"))


def near_water(df: DataFrame, habitat: DataFrame, dist_from_water: float) -> DataFrame:
    """Points in the box around some body of water (``EcoGener = 'WR'`` at ``DistEWat = 0``); each point once.

    Boxes go to the grid cells they meet, points to their own cell; the join is on cells.
    """
    df = ordered(df)
    water = habitat.where((F.col("EcoGener") == "WR") & (F.col("DistEWat") == 0)).select(F.col(LAT).cast("double").alias("_wla"), F.col(LON).cast("double").alias("_wlo")).where("_wla IS NOT NULL AND _wlo IS NOT NULL").distinct()
    cell = geo.cell_for(2 * dist_from_water / 111_000)
    a, b, c, d = geo.bounding_box_columns(F.col("_wla"), F.col("_wlo"), dist_from_water)
    boxes = water.select(a.alias("_a"), b.alias("_b"), c.alias("_c"), d.alias("_d")).withColumn("_cell", F.explode(geo.grid_cells(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"), cell)))
    spots = df.select(LAT, LON).where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()).distinct().withColumn("_cell", geo.grid_cell(F.col(LAT), F.col(LON), cell))
    hits = spots.join(boxes, "_cell").where(F.col(LAT).between(F.col("_a"), F.col("_c")) & F.col(LON).between(F.col("_b"), F.col("_d"))).select(F.col(LAT).alias("_hla"), F.col(LON).alias("_hlo")).distinct()
    return df.join(hits, (F.col(LAT) == F.col("_hla")) & (F.col(LON) == F.col("_hlo")), "left_semi")


def hydration_days(df: DataFrame, habitat: DataFrame, dist_from_water: float) -> DataFrame:
    """``traj_id, Species, days``: distinct days on which an animal was near water."""
    days = near_water(df, habitat, dist_from_water).select(TRAJ, F.to_date(TIME).alias("d")).distinct()
    return days.groupBy(TRAJ).agg(F.count("*").alias("days")).select(TRAJ, species_of_id(F.col(TRAJ)).alias("Species"), "days")


def hydration_hours(df: DataFrame, habitat: DataFrame, dist_from_water: float) -> DataFrame:
    """``Time_Of_Day, part, Species, n``: points near water by part of the day (``part`` orders them)."""
    at = near_water(df, habitat, dist_from_water).select(part_of_day(F.col(TIME)).alias("Time_Of_Day"), species_of_id(F.col(TRAJ)).alias("Species"))
    order = F.array_position(F.array(*(F.lit(label) for _, label in PARTS)), F.col("Time_Of_Day")).cast("int")
    return at.groupBy("Time_Of_Day", "Species").agg(F.count("*").alias("n")).withColumn("part", order)


def pasture_bounds(habitat: DataFrame, column: str = "CowPast") -> DataFrame:
    need(habitat, column, LAT, LON)
    return habitat.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(LAT).alias("min_lat"), F.min(LON).alias("min_lon"), F.max(LAT).alias("max_lat"), F.max(LON).alias("max_lon"))


def animals_by_pasture(df: DataFrame, habitat: DataFrame, column: str = "CowPast") -> DataFrame:
    """``{column}, Species, n``: distinct animals that were within each pasture's bounds, by species. Pastures and points
    meet on grids by size class, so a wide pasture does not coarsen the search for small ones."""
    boxes = pasture_bounds(habitat, column)
    side = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"))
    boxes = boxes.withColumn("_class", geo.size_class(side, 16))
    classes = sorted(r["_class"] for r in boxes.select("_class").distinct().collect() if r["_class"] is not None)  # at most geo.CLASSES
    boxes = boxes.withColumn("_cell", F.explode(geo.cells_of_class(F.col("_class"), classes, (F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), F.col("max_lon")))))
    points = df.select(TRAJ, LAT, LON).where(F.col(LAT).isNotNull() & F.col(LON).isNotNull()).withColumn("_cell", F.explode(geo.cells_of_point(F.col(LAT), F.col(LON), classes)))
    met = points.join(boxes, "_cell").where(F.col(LAT).between(F.col("min_lat"), F.col("max_lat")) & F.col(LON).between(F.col("min_lon"), F.col("max_lon")))
    return met.select(column, TRAJ).distinct().groupBy(column, species_of_id(F.col(TRAJ)).alias("Species")).agg(F.count("*").alias("n"))


def pasture_stats(habitat: DataFrame, column: str = "CowPast", averages: tuple[str, ...] = ("Canopy", "Elev", "DistOPEN")) -> DataFrame:
    """Means of the given columns and the number of watering places (``DistEWat = 0``) per pasture."""
    need(habitat, column, "DistEWat", *averages)
    return habitat.where(F.col(column).isNotNull()).groupBy(column).agg(*(F.avg(c).alias(f"mean_{c}") for c in averages), F.count_if(F.col("DistEWat") == 0).alias("n_water"))


def pasture_areas(habitat: DataFrame, column: str = "CowPast", order: str = "vertex_no", polygon: tuple[str, ...] = ("region_id", "ring"), hole: str | None = "ring") -> DataFrame:
    """``{column}, area``: Web Mercator area of each pasture in units of 1e7 m2: its outer rings (shoelace over vertices in
    ``order``) less their holes (``hole`` > 0). Columns of ``polygon`` that are absent are left out. Edges go the short
    way round, also over the 180th meridian.

    The sum needs only successive vertices, so it is a window and a partial sum rather than an array per polygon.
    """
    need(habitat, column, order, LAT, LON)
    keys = [column, *(c for c in polygon if c in habitat.columns and c != column)]
    _, y = geo.mercator(F.col(LAT).cast("double"), F.lit(0.0))
    lon = F.col(LON).cast("double")
    known = habitat.where(F.col(column).isNotNull() & F.col(LAT).isNotNull() & F.col(LON).isNotNull())
    v = known.select(*keys, F.col(order).alias("_o"), lon.alias("_lon"), y.alias("_y"))
    w = Window.partitionBy(*keys).orderBy("_o", "_lon", "_y")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("_lon") - F.lag("_lon").over(w)
    # metres east of the first vertex, along the edges
    v = v.withColumn("_east", F.coalesce(F.pmod(step + 180, F.lit(360.0)) - 180, F.lit(0.0))).withColumn("_x", F.radians(F.sum("_east").over(whole)) * 6378137.0)
    nx, ny = F.coalesce(F.lead("_x").over(w), F.lit(0.0)), F.coalesce(F.lead("_y").over(w), F.first("_y").over(whole))
    y0 = F.first("_y").over(whole)
    rings = v.withColumn("_term", F.col("_x") * (ny - y0) - nx * (F.col("_y") - y0)).groupBy(*keys).agg((F.abs(F.sum("_term")) / 2 / 1e7).alias("_area"))
    signed = F.when(F.col(hole) > 0, -F.col("_area")).otherwise(F.col("_area")) if hole in keys else F.col("_area")
    return rings.groupBy(column).agg(F.sum(signed).alias("area"))


def trajectory_map(df: DataFrame, traj_ids: list[str] | None = None) -> DataFrame:
    """``traj_id, n, min_lat, min_lon, max_lat, max_lon``: what a map needs to frame the chosen trajectories."""
    kept = df if traj_ids is None else df.where(F.col(TRAJ).isin(*traj_ids))
    return kept.groupBy(TRAJ).agg(F.count("*").alias("n"), F.min(LAT).alias("min_lat"), F.min(LON).alias("min_lon"), F.max(LAT).alias("max_lat"), F.max(LON).alias("max_lon"))


def trajectory_lines(df: DataFrame, traj_ids: list[str]) -> DataFrame:
    """``traj_id, position, lat, lon``: the points of chosen trajectories in drawing order, one per row."""
    w = Window.partitionBy(TRAJ).orderBy(TIME, ROW)
    rows = ordered(df).where(F.col(TRAJ).isin(*traj_ids) & F.col(LAT).isNotNull() & F.col(LON).isNotNull())
    return rows.select(TRAJ, F.row_number().over(w).alias("position"), LAT, LON)


def ids_by_species(df: DataFrame, column: str = "Species") -> DataFrame:
    """``Species, traj_id``: the distinct trajectories of each species code."""
    need(df, column, TRAJ)
    return df.select(species_of_code(F.col(column)).alias("Species"), TRAJ).where("Species IS NOT NULL").distinct()
