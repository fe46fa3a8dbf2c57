"""Point features on a stream of pings.

Stateless operators (calendar features, boxes, polygons, distance from a fixed point) work on streams as they are.
Features that need the point before keep one point per trajectory as state, so a stream of any length needs space for
its live trajectories only; idle ones are forgotten after ``idle_s`` seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.functions.npgeo import haversine_m
from pathloom.functions.times import micros
from pathloom.schema import LAT, LON, TIME, TRAJ, need

_OUT = "traj_id string, t_us long, lat double, lon double, Distance double, Speed double"
_STATE = "t long, lat double, lon double"


def stream_distance_and_speed(pings: DataFrame, idle_s: int = 86400) -> DataFrame:
    """``traj_id, DateTime, lat, lon, Distance, Speed`` for a streaming (or batch) table of pings.

    Within a micro-batch pings are taken in order of time. A ping that is older than the last one already taken of its
    trajectory comes out with null features and does not become the last one. Pings that lack id, time or a
    coordinate are left out. As in the batch operators the first ping has null features, and so has a speed over
    no time.
    """
    need(pings, TRAJ, TIME, LAT, LON)
    la, lo = F.col(LAT).cast("double"), F.col(LON).cast("double")
    ok = ~F.isnan(la) & ~F.isnan(lo) & F.col(TRAJ).isNotNull() & F.col(TIME).isNotNull()
    rows = pings.where(ok).select(F.col(TRAJ).cast("string").alias(TRAJ), micros(TIME).alias("t_us"), la.alias(LAT), lo.alias(LON))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        d = pd.concat(list(batches), ignore_index=True).sort_values("t_us", kind="stable")
        last = state.getOption
        late = d["t_us"].to_numpy() < (last[0] if last else np.iinfo("int64").min)
        live = d[~late]
        t, lat, lon = (live[c].to_numpy() for c in ("t_us", LAT, LON))
        t0, lat0, lon0 = (np.r_[[last[i]] if last else [np.nan], v[:-1]] for i, v in enumerate((t, lat, lon)))
        dist = haversine_m(lat0, lon0, lat, lon)
        dt = (t - t0) / 1e6
        speed = np.where(dt > 0, dist / np.where(dt > 0, dt, 1.0), np.nan)
        if len(live):
            state.update((int(t[-1]), float(lat[-1]), float(lon[-1])))
        state.setTimeoutDuration(int(idle_s) * 1000)
        out = pd.concat([live.assign(Distance=dist, Speed=speed), d[late].assign(Distance=np.nan, Speed=np.nan)])
        yield out[[TRAJ, "t_us", LAT, LON, "Distance", "Speed"]]

    out = rows.groupBy(TRAJ).applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    at = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(t_us / 1000000 AS decimal(18, 6)))")
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(TRAJ, at.alias(TIME), LAT, LON, clean("Distance"), clean("Speed"))
