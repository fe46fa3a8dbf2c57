"""Row filters.

A filter on stored columns reaches the scan; a filter on ``traj_id`` also passes below the feature windows. A filter
on a derived feature derives it first if it is absent. Null features never pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators.even import CHUNK, GHOST, GIANT, giants, spread
from pathloom.operators.kinematic import create_distance_column, create_speed_column
from pathloom.operators.quantiles import exact_quantiles
from pathloom.schema import LAT, LON, ROW, TIME, TRAJ, MissingTrajIDException, need, ordered, track


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row for each (time, trajectory, lat, lon): the one with the smallest row id. Equal means null-safe equal."""
    df = ordered(df)
    rest = [c for c in df.columns if c not in (TIME, TRAJ, LAT, LON)]
    # an aggregate, not a window: copies meet in partial aggregation before the shuffle
    kept = df.groupBy(TIME, TRAJ, LAT, LON).agg(F.min_by(F.struct(*[f"`{c}`" for c in rest]), ROW).alias("_kept"))
    return kept.select(*[F.col(f"_kept.`{c}`").alias(c) if c in rest else F.col(c) for c in df.columns])


def filter_by_traj_id(df: DataFrame, traj_id: str) -> DataFrame:
    need(df, TRAJ)
    out = df.where(F.col(TRAJ) == str(traj_id))
    if out.select(TRAJ).isEmpty():
        raise MissingTrajIDException(f"no trajectory {traj_id}")
    return out


def filter_by_bounding_box(df: DataFrame, box: tuple[float, float, float, float], inside: bool = True) -> DataFrame:
    """``box``: (min_lat, min_lon, max_lat, max_lon), edges included. Points that lack a coordinate are outside."""
    need(df, LAT, LON)
    p = geo.in_box(F.col(LAT), F.col(LON), box)
    return df.where(p) if inside else df.where(~F.coalesce(p, F.lit(False)))


get_bounding_box_by_radius = geo.bounding_box_by_radius


def _between(df: DataFrame, value: Column, start, end, kind: str) -> DataFrame:
    if start is None and end is None:
        raise ValueError("a start or an end is needed")
    if start is not None and end is not None and str(end) < str(start):
        raise ValueError(f"end {end} is before start {start}")
    if start is not None:
        df = df.where(value >= F.lit(str(start)).cast(kind))
    return df if end is None else df.where(value <= F.lit(str(end)).cast(kind))


def filter_by_date(df: DataFrame, start_date: dt.date | str | None = None, end_date: dt.date | str | None = None) -> DataFrame:
    """Both dates included, either may be absent. Written as bounds on the time, so that it reaches the scan."""
    need(df, TIME)
    if start_date is None and end_date is None:
        raise ValueError("a start or an end is needed")
    first, last = (dt.date.fromisoformat(str(d)) if d is not None else None for d in (start_date, end_date))
    if first and last and last < first:
        raise ValueError(f"end {last} is before start {first}")
    if first:
        df = df.where(F.col(TIME) >= F.lit(str(first)).cast("timestamp_ntz"))
    if last:
        df = df.where(F.col(TIME) < F.lit(str(last + dt.timedelta(days=1))).cast("timestamp_ntz"))
    return df


def filter_by_datetime(df: DataFrame, start_dateTime: dt.datetime | str | None = None, end_dateTime: dt.datetime | str | None = None) -> DataFrame:
    need(df, TIME)
    return _between(df, F.col(TIME), start_dateTime, end_dateTime, "timestamp_ntz")


def _with_speed(df: DataFrame) -> DataFrame:
    return df if "Speed" in df.columns else create_speed_column(df)


def _with_distance(df: DataFrame) -> DataFrame:
    return df if "Distance" in df.columns else create_distance_column(df)


def filter_by_max_speed(df: DataFrame, max_speed: float) -> DataFrame:
    return _with_speed(df).where(F.col("Speed") <= float(max_speed))


def filter_by_min_speed(df: DataFrame, min_speed: float) -> DataFrame:
    return _with_speed(df).where(F.col("Speed") >= float(min_speed))


def filter_by_min_consecutive_distance(df: DataFrame, min_distance: float) -> DataFrame:
    return _with_distance(df).where(F.col("Distance") >= float(min_distance))


def filter_by_max_consecutive_distance(df: DataFrame, max_distance: float) -> DataFrame:
    return _with_distance(df).where(F.col("Distance") <= float(max_distance))


def filter_by_max_distance_and_speed(df: DataFrame, max_distance: float, max_speed: float) -> DataFrame:
    return _with_speed(_with_distance(df)).where((F.col("Distance") <= float(max_distance)) & (F.col("Speed") <= float(max_speed)))


def filter_by_min_distance_and_speed(df: DataFrame, min_distance: float, min_speed: float) -> DataFrame:
    return _with_speed(_with_distance(df)).where((F.col("Distance") >= float(min_distance)) & (F.col("Speed") >= float(min_speed)))


def _within_quartiles(df: DataFrame, column: str) -> DataFrame:
    """Keeps values strictly within 1.5 interquartile ranges of the quartiles of the whole table (exact)."""
    q1, q3 = exact_quantiles(df, F.col(column), [0.25, 0.75])
    if q1 is None:
        return df.where(F.lit(False))
    reach = 1.5 * (q3 - q1)
    return df.where((F.col(column) > q1 - reach) & (F.col(column) < q3 + reach))


def filter_outliers_by_consecutive_distance(df: DataFrame) -> DataFrame:
    return _within_quartiles(_with_distance(df), "Distance")


def filter_outliers_by_consecutive_speed(df: DataFrame) -> DataFrame:
    return _within_quartiles(_with_speed(df), "Speed")


def remove_trajectories_with_less_points(df: DataFrame, num_min_points: int = 3) -> DataFrame:
    """Keeps trajectories of at least so many points.

    Counts are aggregated before the shuffle, and the rows are joined to the short list of small ids (anti join), so
    a large trajectory is never gathered.
    """
    need(df, TRAJ)
    small = df.groupBy(TRAJ).agg(F.count("*").alias("_n")).where(F.col("_n") < int(num_min_points)).select(F.col(TRAJ).alias("_small"))
    return df.join(small, F.col(TRAJ).eqNullSafe(F.col("_small")), "left_anti")


def hampel_outlier_detection(df: DataFrame, column: str, window: int = 5, n: float = 3.0, giant: int | None = GIANT) -> DataFrame:
    """Drops rows whose value is further than ``n`` deviations from the rolling median of their trajectory.

    The window is the ``window`` rows before the row and the ``window - 1`` after the row with it; only full windows
    without nulls count. A row without one takes median and deviation of the next such row of the trajectory, else of
    the last one before. The deviation is 1.4826 times the median absolute deviation. Rows with a null value stay.
    Features computed before are not computed again. Giant trajectories are cut into chunks (``even.py``).
    """
    need(df, column)
    df = ordered(df)
    large = giants(df, [TRAJ], giant)
    keys = [TRAJ] if large is None else [TRAJ, CHUNK]
    rows = df if large is None else spread(df, large, [TRAJ], window, window - 1, giant=giant)
    size = 2 * window
    w = track(*keys[1:])
    values = F.collect_list(F.col(f"`{column}`").cast("double")).over(w.rowsBetween(-window, window - 1))
    middle = lambda a: (F.element_at(a, window) + F.element_at(a, window + 1)) / 2
    step1 = rows.withColumn("_hampel_v", values)
    step2 = step1.withColumn("_hampel_m", F.when(F.size("_hampel_v") == size, middle(F.array_sort("_hampel_v"))))
    step3 = step2.withColumn("_hampel_s", F.when(F.col("_hampel_m").isNotNull(), 1.4826 * middle(F.array_sort(F.transform("_hampel_v", lambda x: F.abs(x - F.col("_hampel_m")))))))
    step4 = step3.withColumn("_hampel_p", F.when(F.col("_hampel_m").isNotNull(), F.struct("_hampel_m", "_hampel_s")))
    if large is not None:
        step4 = step4.where(~F.col(GHOST))
    # "the next one" is the last one in reverse order: a growing frame, linear in the length of a trajectory
    back = Window.partitionBy(*keys).orderBy(F.desc(TIME), F.desc(ROW))
    ahead, behind = back.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    ways = [F.last("_hampel_p", ignorenulls=True).over(ahead), F.last("_hampel_p", ignorenulls=True).over(behind)]
    if large is not None:  # one row a chunk tells what the other chunks have
        at = F.when(F.col("_hampel_p").isNotNull(), F.struct(TIME, ROW))
        chunks = step4.groupBy(*keys).agg(F.min_by("_hampel_p", at).alias("_first_p"), F.max_by("_hampel_p", at).alias("_last_p"))
        order = Window.partitionBy(TRAJ).orderBy(CHUNK)
        told = chunks.select(
            F.col(TRAJ).alias("_hk"), F.col(CHUNK).alias("_hc"), F.first("_first_p", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_next_p"),
            F.last("_last_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_p"),
        )
        step4 = step4.join(told, step4[TRAJ].eqNullSafe(F.col("_hk")) & (step4[CHUNK] == F.col("_hc")), "left").drop("_hk", "_hc")
        ways = [ways[0], F.col("_next_p"), ways[1], F.col("_prev_p")]
    step5 = step4.withColumn("_hampel_q", F.coalesce(*ways))
    far = F.abs(F.col(f"`{column}`") - F.col("_hampel_q._hampel_m")) > n * F.col("_hampel_q._hampel_s")
    return step5.where(~F.coalesce(far, F.lit(False))).select(*(f"`{c}`" for c in df.columns))
