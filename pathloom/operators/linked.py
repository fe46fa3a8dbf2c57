"""Kinematic features for tables in which one trajectory holds a large part of all rows.

``kinematic.py`` uses one window per trajectory, which is right for many trajectories but puts a giant one into a
single task. Here the windows run over (trajectory, time chunk), so a giant is spread over its chunks. What a chunk
lacks (up to three points before its first ones, and the trajectory's first point) comes from a second window over
the chunk edges only: six rows per chunk and trajectory. Each row then holds its predecessors, and all features are
expressions on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.schema import FEATURES, LAT, LON, ROW, TIME, TRAJ, ordered

DEPTH = 3  # the deepest derivative looks three points back
_PT = "_link"


def _predecessors(df: DataFrame, chunk_s: int) -> DataFrame:
    """``_link1.._link3`` (structs of time, lat, lon) and ``_first``, the first point of the trajectory."""
    chunk = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(TIME)) / int(chunk_s))
    point = F.struct(F.col(TIME).alias("t"), F.col(LAT).alias("la"), F.col(LON).alias("lo"))
    inner = Window.partitionBy(TRAJ, "_chunk").orderBy(TIME, ROW)
    rows = df.withColumn("_chunk", chunk).withColumn("_pt", point)
    near = rows.withColumns({f"{_PT}{i}": F.lag("_pt", i).over(inner) for i in range(1, DEPTH + 1)} | {"_n": F.row_number().over(inner), "_of": F.count("*").over(Window.partitionBy(TRAJ, "_chunk"))})
    edge = near.where((F.col("_n") <= DEPTH) | (F.col("_n") > F.col("_of") - DEPTH))
    outer = Window.partitionBy(TRAJ).orderBy(TIME, ROW)
    linked = edge.select(TRAJ, "_chunk", "_n", F.first("_pt").over(outer).alias("_f"), *(F.lag("_pt", i).over(outer).alias(f"_e{i}") for i in range(1, DEPTH + 1))).where(F.col("_n") <= DEPTH)
    # one row per chunk: the links of its first three points, in order
    heads = linked.groupBy(TRAJ, "_chunk").agg(F.first("_f").alias("_first"), F.array_sort(F.collect_list(F.struct("_n", *(f"_e{i}" for i in range(1, DEPTH + 1))))).alias("_heads"))
    heads = heads.withColumnsRenamed({TRAJ: "_ht", "_chunk": "_hc"})
    met = near.join(heads, F.col(TRAJ).eqNullSafe(F.col("_ht")) & F.col("_chunk").eqNullSafe(F.col("_hc")), "left")
    fixed = {f"{_PT}{i}": F.when(F.col("_n") <= DEPTH, F.get("_heads", F.col("_n") - 1)[f"_e{i}"]).otherwise(F.col(f"{_PT}{i}")) for i in range(1, DEPTH + 1)}
    return met.withColumns(fixed).drop("_ht", "_hc", "_heads", "_n", "_of", "_chunk")


def _seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a["t"], b["t"]) / F.lit(1e6)


def generate_kinematic_features_chunked(df: DataFrame, chunk_s: int = 86400) -> DataFrame:
    """The eight features of ``generate_kinematic_features``, equal to the last bit, for any skew.

    ``chunk_s``: seconds per chunk; a chunk of the largest trajectory should hold some 10,000 to 1,000,000 points.
    Existing feature columns are computed anew.
    """
    rows = _predecessors(ordered(df.drop(*FEATURES)), chunk_s)
    p = [F.col("_pt"), *(F.col(f"{_PT}{i}") for i in range(1, DEPTH + 1))]
    dt = [_seconds(p[i + 1], p[i]) for i in range(DEPTH)]
    dist = [geo.haversine(p[i + 1]["la"], p[i + 1]["lo"], p[i]["la"], p[i]["lo"]) for i in range(DEPTH)]
    turn = [geo.bearing(p[i + 1]["la"], p[i + 1]["lo"], p[i]["la"], p[i]["lo"]) for i in range(DEPTH)]
    speed = [F.try_divide(dist[i], dt[i]) for i in range(DEPTH)]
    acc = [F.try_divide(speed[i] - speed[i + 1], dt[i]) for i in range(DEPTH - 1)]
    rate = [F.try_divide(turn[i] - turn[i + 1], dt[i]) for i in range(DEPTH - 1)]
    first = F.col("_first")
    out = {
        "Distance": dist[0], "Distance_from_start": F.when(p[1].isNotNull(), geo.haversine(first["la"], first["lo"], p[0]["la"], p[0]["lo"])), "Speed": speed[0], "Acceleration": acc[0],
        "Jerk": F.try_divide(acc[0] - acc[1], dt[0]), "Bearing": turn[0], "Bearing_Rate": rate[0], "Rate_of_bearing_rate": F.try_divide(rate[0] - rate[1], dt[0]),
    }
    return rows.withColumns(out).drop("_pt", "_first", *(f"{_PT}{i}" for i in range(1, DEPTH + 1)))
