"""Point features along a trajectory.

All features share one window, so any chain of them is planned with one exchange and one sort; giant trajectories are
cut into chunks (``even.py``). Features that are already present are used, absent ones are derived first. The first row of
a trajectory has no distance, and each derivative has one null more at the start; a zero time difference gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators.even import even, of_origin
from pathloom.schema import LAT, LON, TIME, need, ordered, track


def _dt(w) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lag(TIME).over(w), F.col(TIME)) / F.lit(1e6)


def _rate(name: str, w) -> Column:
    return F.try_divide(F.col(name) - F.lag(name).over(w), _dt(w))


@even(before=1)
def create_distance_column(df: DataFrame, *within: str) -> DataFrame:
    """``Distance``: metres from the previous point."""
    w = track(*within)
    return ordered(df).withColumn("Distance", geo.haversine(F.lag(LAT).over(w), F.lag(LON).over(w), F.col(LAT), F.col(LON)))


@even(before=1, origin=(LAT, LON))
def create_distance_from_start_column(df: DataFrame, *within: str) -> DataFrame:
    """``Distance_from_start``: metres from the first point; null on the first row itself."""
    w = track(*within)
    df = ordered(df)
    d = geo.haversine(of_origin(df, LAT, F.first(LAT).over(w)), of_origin(df, LON, F.first(LON).over(w)), F.col(LAT), F.col(LON))
    return df.withColumn("Distance_from_start", F.when(F.row_number().over(w) > 1, d))


def create_distance_from_point_column(df: DataFrame, coordinates: tuple[float, float], name: str | None = None) -> DataFrame:
    """``Distance_from_(lat, lon)``: metres from a fixed point."""
    need(df, LAT, LON)
    return df.withColumn(name or f"Distance_from_{tuple(coordinates)}", geo.haversine(coordinates[0], coordinates[1], F.col(LAT), F.col(LON)))


def create_point_within_range_column(df: DataFrame, coordinates: tuple[float, float], radius: float, name: str | None = None) -> DataFrame:
    """``Within_{radius}_m_from_...``: whether a point lies within ``radius`` metres, the edge included."""
    need(df, LAT, LON)
    return df.withColumn(name or f"Within_{radius}_m", geo.haversine(coordinates[0], coordinates[1], F.col(LAT), F.col(LON)) <= float(radius))


@even(before=1)
def create_speed_column(df: DataFrame, *within: str) -> DataFrame:
    """``Speed`` in metres per second."""
    df = ordered(df) if "Distance" in df.columns else create_distance_column(df, *within, giant=None)
    return df.withColumn("Speed", F.try_divide("Distance", _dt(track(*within))))


@even(before=2)
def create_acceleration_column(df: DataFrame, *within: str) -> DataFrame:
    """``Acceleration`` in metres per second squared."""
    df = ordered(df) if "Speed" in df.columns else create_speed_column(df, *within, giant=None)
    return df.withColumn("Acceleration", _rate("Speed", track(*within)))


@even(before=3)
def create_jerk_column(df: DataFrame, *within: str) -> DataFrame:
    """``Jerk`` in metres per second cubed."""
    df = ordered(df) if "Acceleration" in df.columns else create_acceleration_column(df, *within, giant=None)
    return df.withColumn("Jerk", _rate("Acceleration", track(*within)))


@even(before=1)
def create_bearing_column(df: DataFrame, *within: str) -> DataFrame:
    """``Bearing`` in degrees from the previous point."""
    w = track(*within)
    return ordered(df).withColumn("Bearing", geo.bearing(F.lag(LAT).over(w), F.lag(LON).over(w), F.col(LAT), F.col(LON)))


@even(before=2)
def create_bearing_rate_column(df: DataFrame, *within: str) -> DataFrame:
    """``Bearing_Rate`` in degrees per second, without wrapping at north."""
    df = ordered(df) if "Bearing" in df.columns else create_bearing_column(df, *within, giant=None)
    return df.withColumn("Bearing_Rate", _rate("Bearing", track(*within)))


@even(before=3)
def create_rate_of_br_column(df: DataFrame, *within: str, compat: bool = False) -> DataFrame:
    """``Rate_of_bearing_rate``: the second derivative of the bearing.

    ``compat``: the first derivative again where ``Bearing_Rate`` has to be derived here.
    """
    derived = "Bearing_Rate" not in df.columns
    df = create_bearing_rate_column(df, *within, giant=None) if derived else ordered(df)
    return df.withColumn("Rate_of_bearing_rate", _rate("Bearing" if derived and compat else "Bearing_Rate", track(*within)))


@even(before=3, origin=(LAT, LON))
def generate_kinematic_features(df: DataFrame, *within: str, compat: bool = False) -> DataFrame:
    """All eight features in one pass over one sorted window."""
    df = create_distance_from_start_column(create_distance_column(df, *within, giant=None), *within, giant=None)
    return create_rate_of_br_column(create_jerk_column(df, *within, giant=None), *within, compat=compat, giant=None)
