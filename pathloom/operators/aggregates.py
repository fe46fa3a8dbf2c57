"""Results per trajectory and for the whole table.

All are partial aggregates (one row per trajectory and task before the shuffle), so large trajectories shrink
first. An unknown id raises ``MissingTrajIDException``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.even import GIANT
from pathloom.operators.kinematic import create_distance_column
from pathloom.schema import LAT, LON, ROW, TIME, TRAJ, MissingTrajIDException, need, ordered


def _one(df: DataFrame, traj_id: str | None) -> DataFrame:
    return df if traj_id is None else df.where(F.col(TRAJ) == traj_id)


def _answer(table: DataFrame, traj_id: str | None):
    """The table, or the single row of one id."""
    if traj_id is None:
        return table
    row = table.first()
    if row is None:
        raise MissingTrajIDException(f"no trajectory {traj_id}")
    return row


def get_bounding_box(df: DataFrame) -> tuple[float, float, float, float]:
    """``(min_lat, min_lon, max_lat, max_lon)`` of the whole table."""
    return tuple(bounding_box(df).first())


def bounding_box(df: DataFrame) -> DataFrame:
    need(df, LAT, LON)
    return df.agg(F.min(LAT).alias("min_lat"), F.min(LON).alias("min_lon"), F.max(LAT).alias("max_lat"), F.max(LON).alias("max_lon"))


def _end(df: DataFrame, traj_id: str | None, pick, order: Column):
    at = pick(F.struct(LAT, LON), order)
    table = _one(ordered(df), traj_id).groupBy(TRAJ).agg(at.alias("p")).select(TRAJ, F.col("p.lat").alias(LAT), F.col("p.lon").alias(LON))
    row = _answer(table, traj_id)
    return row if traj_id is None else (row[LAT], row[LON])


def get_start_location(df: DataFrame, traj_id: str | None = None):
    """Coordinates at the earliest time (the first row among equal times)."""
    return _end(df, traj_id, F.min_by, F.struct(TIME, ROW))


def get_end_location(df: DataFrame, traj_id: str | None = None):
    """Coordinates at the latest time (the first row among equal times)."""
    return _end(df, traj_id, F.max_by, F.struct(F.col(TIME), (-F.col(ROW)).alias("r")))


def get_start_time(df: DataFrame, traj_id: str | None = None):
    row = _answer(_one(df, traj_id).groupBy(TRAJ).agg(F.min(TIME).alias(TIME)), traj_id)
    return row if traj_id is None else row[TIME]


def get_end_time(df: DataFrame, traj_id: str | None = None):
    row = _answer(_one(df, traj_id).groupBy(TRAJ).agg(F.max(TIME).alias(TIME)), traj_id)
    return row if traj_id is None else row[TIME]


def get_traj_duration(df: DataFrame, traj_id: str | None = None):
    """``Traj_Duration`` as an interval, and in seconds."""
    span = _one(df, traj_id).groupBy(TRAJ).agg(F.min(TIME).alias("a"), F.max(TIME).alias("z"))
    table = span.select(TRAJ, (F.col("z") - F.col("a")).alias("Traj_Duration"), (F.timestamp_diff("MICROSECOND", F.col("a"), F.col("z")) / 1e6).alias("seconds"))
    row = _answer(table, traj_id)
    return row if traj_id is None else row["Traj_Duration"]


def get_number_of_locations(df: DataFrame, traj_id: str | None = None):
    """Distinct coordinates per trajectory; points that lack one do not count."""
    column = "Number of Unique Coordinates"
    # distinct pairs first: partial, and spread by coordinates rather than by trajectory
    pairs = _one(df, traj_id).select(TRAJ, LAT, LON).distinct()
    table = pairs.groupBy(TRAJ).agg(F.count(F.when(F.col(LAT).isNotNull() & F.col(LON).isNotNull(), 1)).alias(column))
    row = _answer(table, traj_id)
    return row if traj_id is None else row[column]


def distance_travelled(df: DataFrame, giant: int | None = GIANT) -> DataFrame:
    """Metres travelled by every trajectory; 0 for a single point."""
    return create_distance_column(df, giant=giant).groupBy(TRAJ).agg(F.coalesce(F.sum("Distance"), F.lit(0.0)).alias("Distance"))


def get_distance_travelled_by_traj_id(df: DataFrame, traj_id: str) -> float:
    return _answer(distance_travelled(_one(df, traj_id)), traj_id)["Distance"]


def distance_travelled_by_date(df: DataFrame) -> DataFrame:
    """Metres travelled within each day of each trajectory; the first point of a day adds nothing."""
    days = ordered(df).withColumn("Date", F.to_date(TIME))
    return create_distance_column(days, "Date").groupBy(TRAJ, "Date").agg(F.coalesce(F.sum("Distance"), F.lit(0.0)).alias("Distance"))


def get_distance_travelled_by_date_and_traj_id(df: DataFrame, date: dt.date | str, traj_id: str) -> float:
    day = F.lit(str(date)).cast("date")
    return _answer(distance_travelled_by_date(_one(df, traj_id).where(F.to_date(TIME) == day)), traj_id)["Distance"]


def dataset_facts(df: DataFrame) -> DataFrame:
    """One row: trajectories, points, time span and bounding box."""
    need(df, TRAJ, TIME, LAT, LON)
    # two levels: the distinct ids are not gathered in one task
    per = df.groupBy(TRAJ).agg(F.count("*").alias("n"), F.min(TIME).alias("a"), F.max(TIME).alias("z"), F.min(LAT).alias("la"), F.min(LON).alias("lo"), F.max(LAT).alias("la1"), F.max(LON).alias("lo1"))
    return per.agg(
        F.count(TRAJ).alias("n_trajectories"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"), F.min("a").alias("start_time"), F.max("z").alias("end_time"),
        F.min("la").alias("min_lat"), F.min("lo").alias("min_lon"), F.max("la1").alias("max_lat"), F.max("lo1").alias("max_lon"),
    )
