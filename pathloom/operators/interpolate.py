"""Gap filling: one new point per gap above the sampling rate, ``sampling_rate`` seconds after the gap's start.

The result has ``DateTime, traj_id, lat, lon`` (and the class label, the trajectory's first one, if named). Linear and
kinematic interpolation are expressions over one sorted window; cubic is a spline per trajectory (Arrow kernel over even blocks);
random walk draws once per trajectory from a hash of its id and the seed, so it does not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pathloom.functions.times import micros
from pathloom.operators.blocks import OrderedBlocks, edges, halos
from pathloom.operators.even import CHUNK, GHOST, GIANT, giants, of_origin, spread
from pathloom.operators.kinematic import create_bearing_column, create_distance_column
from pathloom.schema import LAT, LON, ROW, TIME, TRAJ, need, ordered, track

EARTH_M = 6371000.0


def _prepared(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    df = ordered(df)
    extra = [label] if label else []
    need(df, *extra)
    return df.select(TIME, TRAJ, LAT, LON, *extra, ROW), extra


def _gaps(df: DataFrame, rate: float, extra: list[str], more: dict[str, Column]) -> DataFrame:
    """The row at the end of each gap above ``rate`` seconds, with what preceded it."""
    w = _window(df)
    cols = {"_t0": F.lag(TIME).over(w), "_la": F.lag(LAT).over(w), "_lo": F.lag(LON).over(w)} | {f"_first_{c}": of_origin(df, c, F.first(f"`{c}`").over(w)) for c in extra} | more
    out = df.withColumns(cols).withColumn("_dt", F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col(TIME)) / 1e6)
    out = out.where(F.col("_dt") > float(rate))
    return out.where(~F.col(GHOST)) if GHOST in df.columns else out


def _window(df: DataFrame) -> WindowSpec:
    return track(CHUNK) if CHUNK in df.columns else track()


def _even(df: DataFrame, extra: list[str], giant: int | None) -> DataFrame:
    """The rows for the windows: giant trajectories in chunks (``even.py``)."""
    large = giants(df, [TRAJ], giant)
    return df if large is None else spread(df, large, [TRAJ], 2, origin=tuple(extra) or (TRAJ,), giant=giant)


def _new_time(rate: float) -> Column:
    return F.col("_t0") + F.make_dt_interval(secs=F.lit(float(rate)).cast("decimal(18,6)"))


def _with_new(df: DataFrame, gaps: DataFrame, rate: float, lat: Column, lon: Column, extra: list[str]) -> DataFrame:
    made = gaps.select(_new_time(rate).alias(TIME), TRAJ, lat.alias(LAT), lon.alias(LON), *[F.col(f"_first_{c}").alias(c) for c in extra])
    return df.select(TIME, TRAJ, LAT, LON, *extra).unionByName(made)


def _linear(df: DataFrame, rate: float, extra: list[str], giant: int | None) -> DataFrame:
    part = float(rate) / F.col("_dt")
    return _with_new(df, _gaps(_even(df, extra, giant), rate, extra, {}), rate, F.col("_la") + (F.col(LAT) - F.col("_la")) * part, F.col("_lo") + (F.col(LON) - F.col("_lo")) * part, extra)


def _kinematic(df: DataFrame, rate: float, extra: list[str], compat: bool, giant: int | None) -> DataFrame:
    rows = _even(df, extra, giant)
    w = _window(rows)
    dt = F.timestamp_diff("MICROSECOND", F.lag(TIME).over(w), F.col(TIME)) / 1e6
    moved = rows.withColumns({"_vla": F.try_divide(F.col(LAT) - F.lag(LAT).over(w), dt), "_vlo": F.try_divide(F.col(LON) - F.lag(LON).over(w), dt)})
    gaps = _gaps(moved, rate, extra, {"_vla0": F.lag("_vla").over(w), "_vlo0": F.lag("_vlo").over(w)}).where(F.col("_vla0").isNotNull() & F.col("_vlo0").isNotNull())
    span = F.col("_dt")
    if compat:
        t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _new_time(rate)) / 1e6 / 1e10
    else:
        t = F.lit(float(rate))

    def at(x0: Column, x1: Column, v0: Column, v1: Column) -> Column:
        r1, r2 = x1 - x0 - v0 * span, v1 - v0
        b = 6 * r1 / (span * span) - 2 * r2 / span
        c = 6 * r2 / (span * span) - 12 * r1 / (span * span * span)
        return x0 + v0 * t + b * t * t / 2 + c * t * t * t / 6

    return _with_new(df, gaps, rate, at(F.col("_la"), F.col(LAT), F.col("_vla0"), F.col("_vla")), at(F.col("_lo"), F.col(LON), F.col("_vlo0"), F.col("_vlo")), extra)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through distinct ascending ``x``; a parabola or line through three or two points."""
    n = len(x)
    if n == 1:
        return np.full(len(at), y[0])
    if n <= 4:
        mid, span = x.mean(), max(np.ptp(x), 1e-9)
        return np.polyval(np.polyfit((x - mid) / span, y, n - 1), (at - mid) / span)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    # slopes s: tridiagonal inside, not-a-knot ends folded into the first and last row
    a, b, c, r = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    a[1:-1], b[1:-1], c[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    r[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    two, end = x[2] - x[0], x[-1] - x[-3]
    b[0], c[0], r[0] = h[1], two, ((h[0] + 2 * two) * h[1] * d[0] + h[0] ** 2 * d[1]) / two
    b[-1], a[-1], r[-1] = h[-2], end, (h[-1] ** 2 * d[-2] + (2 * end + h[-1]) * h[-2] * d[-1]) / end
    for i in range(1, n):
        w = a[i] / b[i - 1]
        b[i] -= w * c[i - 1]
        r[i] -= w * r[i - 1]
    s = np.empty(n)
    s[-1] = r[-1] / b[-1]
    for i in range(n - 2, -1, -1):
        s[i] = (r[i] - c[i] * s[i + 1]) / b[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, hk = at - x[k], h[k]
    c2, c3 = (3 * d[k] - 2 * s[k] - s[k + 1]) / hk, (s[k] + s[k + 1] - 2 * d[k]) / hk**2
    return y[k] + u * (s[k] + u * (c2 + u * c3))


KNOTS = 40  # rows of each neighbouring block; a knot's influence shrinks about fourfold with every knot


def _cubic(df: DataFrame, rate: float, extra: list[str]) -> DataFrame:
    """Splines in even blocks of the ordered table, each with the nearest knots of its neighbours, so that a long
    trajectory is no single task; what lies further away is below double precision."""
    step = int(round(rate * 1e6))
    pings = df.where(F.col(TRAJ).isNotNull() & F.col(TIME).isNotNull()).select(F.col(TRAJ).alias("k"), micros(TIME).alias("t"), LAT, LON, F.col(ROW).alias("r"))
    blocks = OrderedBlocks(pings, ["k", "t"], ["r"], keep=["k", "t", LAT, LON])
    around = halos(blocks.reports(lambda b: edges(b[["k", "t", LAT, LON]], KNOTS), "k string, t long, lat double, lon double, _side string"), KNOTS)

    def fill(block: pd.DataFrame, number: int) -> pd.DataFrame:
        lead, trail = around[number]
        x = pd.concat([lead, block[["k", "t", LAT, LON]], trail], ignore_index=True)
        own = np.zeros(len(x), bool)
        own[len(lead) : len(lead) + len(block)] = True
        k, t = x["k"].to_numpy(), x["t"].to_numpy()
        cut = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(x)]
        out = [pd.DataFrame({"k": pd.Series(dtype=object), "t": pd.Series(dtype="int64"), LAT: pd.Series(dtype=float), LON: pd.Series(dtype=float)})]
        for s, e in zip(cut, cut[1:]):
            gap = s + np.flatnonzero((np.diff(t[s:e]) > step) & own[s : e - 1])
            if e - s <= 3 or not len(gap):
                continue
            new, at = t[gap] + step, {}
            for c in (LAT, LON):
                v = x[c].to_numpy("float64", na_value=np.nan)[s:e]
                ok = ~np.isnan(v)
                xs, first = np.unique(t[s:e][ok], return_index=True)
                at[c] = cubic_spline((xs - t[s]) / 1e6, v[ok][first], (new - t[s]) / 1e6) if len(xs) else np.full(len(new), np.nan)
            out.append(pd.DataFrame({"k": k[s], "t": new} | at))
        return pd.concat(out, ignore_index=True)

    made = blocks.map(fill, "k string, t long, lat double, lon double")
    if extra:
        first = df.groupBy(TRAJ).agg(*(F.min_by(c, F.struct(TIME, ROW)).alias(c) for c in extra)).withColumnRenamed(TRAJ, "_id")
        made = made.join(first, F.col("k") == F.col("_id"))
    at = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(t / 1000000 AS decimal(18, 6)))")
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return df.select(TIME, TRAJ, LAT, LON, *extra).unionByName(made.select(at.alias(TIME), F.col("k").alias(TRAJ), clean(LAT), clean(LON), *extra))


def _random_walk(df: DataFrame, rate: float, extra: list[str], seed: int, giant: int | None) -> DataFrame:
    rows = _even(df, extra, giant)
    within = [CHUNK] if CHUNK in rows.columns else []
    known = create_bearing_column(create_distance_column(rows, *within, giant=None), *within, giant=None)
    known = known.where(~F.col(GHOST)) if within else known
    stat = known.groupBy(TRAJ).agg(F.count("*").alias("_n"), F.avg("Distance").alias("_md"), F.stddev_samp("Distance").alias("_sd"), F.avg("Bearing").alias("_mb"), F.stddev_samp("Bearing").alias("_sb"))
    # 48 bits of a hash that every engine has
    unit = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.col(TRAJ), F.lit(str(seed)), F.lit(str(k)))), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    normal = lambda k: F.sqrt(-2 * F.log(unit(k))) * F.cos(2 * np.pi * unit(k + 1))
    draw = stat.where((F.col("_n") > 3) & F.col("_sd").isNotNull() & F.col("_sb").isNotNull()).select(
        F.col(TRAJ).alias("_id"), (F.col("_md") + F.col("_sd") * normal(0)).alias("_a"), F.radians(F.col("_mb") + F.col("_sb") * normal(2)).alias("_b")
    )
    gaps = _gaps(rows, rate, extra, {}).join(draw, F.col(TRAJ) == F.col("_id"))
    lat = F.col("_la") + F.degrees(F.col("_a") * F.cos("_b") / EARTH_M)
    lon = F.col("_lo") + F.degrees(F.col("_a") * F.sin("_b") / EARTH_M) / F.cos(F.radians("_la"))
    return _with_new(df, gaps, rate, lat, lon, extra)


def interpolate_position(df: DataFrame, sampling_rate: float, ip_type: str = "linear", class_label_col: str = "", compat: bool = False, seed: int = 42, giant: int | None = GIANT) -> DataFrame:
    """``ip_type``: linear, cubic, kinematic or random-walk (case and outer blanks do not matter).

    Cubic and random walk leave trajectories of up to three points as they are; kinematic leaves the gap after a first
    point. ``compat``: the kinematic clock is the epoch in units of 1e10 seconds instead of the time since the gap's
    start.
    """
    kind = ip_type.lower().strip()
    rows, extra = _prepared(df, class_label_col)
    if kind == "linear":
        return _linear(rows, sampling_rate, extra, giant)
    if kind == "cubic":
        return _cubic(rows, sampling_rate, extra)
    if kind == "kinematic":
        return _kinematic(rows, sampling_rate, extra, compat, giant)
    if kind == "random-walk":
        return _random_walk(rows, sampling_rate, extra, seed, giant)
    raise ValueError(f"unknown interpolation {ip_type!r}")
