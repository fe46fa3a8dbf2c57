"""Plain reference answers for the problems, in pandas and loops, over small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pathloom.functions.npgeo import haversine_m


def near_and_inside(p: pd.DataFrame, h: pd.DataFrame, metres: float = 30.0) -> set:
    p = p[p.lat.notna() & p.lon.notna() & p.lat.between(-90, 90) & p.lon.between(-180, 360)].copy()
    p.loc[p.lon >= 180, "lon"] -= 360
    la, lo, pid, who = p.lat.values, p.lon.values, p.point_id.values, p.id.values
    out = set()
    for i in range(len(p)):
        m = np.flatnonzero((pid > pid[i]) & (who != who[i]))
        d = haversine_m(la[i], lo[i], la[m], lo[m])
        out |= {("near", int(pid[i]), int(b)) for b in pid[m[d <= metres]]}
    for r, g in h.groupby("region_id"):
        res = np.zeros(len(p), bool)
        for ring, v in sorted(g.groupby("ring")):
            v = v.sort_values("vertex_no")
            x, y = v.lon.to_numpy(float).copy(), v.lat.values
            for q in range(1, len(x)):
                while x[q] - x[q - 1] > 180:
                    x[q] -= 360
                while x[q] - x[q - 1] < -180:
                    x[q] += 360
            ins = np.zeros(len(p), bool)
            for s in (-360, 0, 360):
                c = np.zeros(len(p), int)
                for q in range(len(x)):
                    x1, y1, x2, y2 = x[q], y[q], x[(q + 1) % len(x)], y[(q + 1) % len(x)]
                    with np.errstate(all="ignore"):
                        c += ((y1 > la) != (y2 > la)) & (lo + s < (x2 - x1) * (la - y1) / (y2 - y1) + x1)
                ins |= c % 2 == 1
            res = ins if ring == 0 else res & ~ins
        out |= {("inside", int(r), int(b)) for b in pid[res]}
    return out


def implausible(df: pd.DataFrame, bounds: dict) -> set:
    cols = [c for c in df.columns if c != "row_id"]
    df = df.sort_values("row_id").drop_duplicates(cols).sort_values(["traj_id", "DateTime", "row_id"])
    out = set()
    for _, g in df.groupby("traj_id"):
        for f, (lo, hi) in bounds.items():
            d = g[g[f].notna()]
            v, ids, sp, la, n = d[f].values, d.row_id.values, d.Speed.values, d.lat.values, len(d)
            u = np.median(np.abs(np.diff(v))) if n > 1 else np.nan
            out |= {(int(ids[i]), f) for i in range(n) if v[i] < lo or v[i] > hi}
            i = 0
            while i < n:
                j = i
                while j < n and v[j] == v[i]:
                    j += 1
                if j - i >= 8:
                    s, p = sp[i:j], la[i:j]
                    s, p = s[~np.isnan(s)], p[~np.isnan(p)]
                    if not (len(s) and (s == 0).all() and len(set(p)) <= 1):
                        out |= {(int(ids[q]), f) for q in range(i, j)}
                i = j
            for w in (1, 2, 3):
                for i in range(1, n - w):
                    b, a = v[i - 1], v[i + w]
                    if abs(a - b) <= 15 * u and all(abs(x - b) > 15 * u and abs(x - a) > 15 * u for x in v[i : i + w]):
                        out |= {(int(q), f) for q in ids[i : i + w]}
    return out


def stretches(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: float = 30.0, least_us: float = 1200e6, elsewhere: int = 3) -> list[tuple[int, int]]:
    """Longest stretches (first, last ping) that some disc of the radius holds, but for up to so many successive pings.

    Every disc that matters can be moved until two of its pings lie on its edge (or one is its centre), so these are tried,
    all of them.
    """
    metre = np.radians(6371000.0)
    x, y = ((lon - lon[0] + 180) % 360 - 180) * np.cos(np.radians(lat.mean())) * metre, (lat - lat[0]) * metre
    far = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    i, j = np.nonzero(np.triu(far <= 4 * radius**2 * (1 + 1e-9), 1))
    d = np.sqrt(far[i, j])
    h = np.sqrt(np.maximum(radius**2 - d * d / 4, 0))
    ux, uy = (x[j] - x[i]) / np.maximum(d, 1e-12), (y[j] - y[i]) / np.maximum(d, 1e-12)
    mx, my = (x[i] + x[j]) / 2, (y[i] + y[j]) / 2
    found = set()
    for cx, cy in zip(np.r_[mx - uy * h, mx + uy * h, x], np.r_[my + ux * h, my - ux * h, y]):
        at = np.flatnonzero((x - cx) ** 2 + (y - cy) ** 2 <= (radius + 1e-6) ** 2)
        for run in np.split(at, np.flatnonzero(np.diff(at) > elsewhere + 1) + 1):
            if len(run) and t[run[-1]] - t[run[0]] >= least_us:
                found.add((int(run[0]), int(run[-1])))
    return [p for p in sorted(found) if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in found)]


def stops_and_trips(df: pd.DataFrame) -> set:
    df = df[df.lat.notna() & df.lon.notna()].sort_values(["traj_id", "DateTime", "row_id"]).drop_duplicates(["traj_id", "DateTime"])
    out = set()
    for k, g in df.groupby("traj_id"):
        t = g.DateTime.values.astype("datetime64[us]").astype("int64")
        la, lo = g.lat.values, g.lon.values
        text = lambda i: str(np.datetime64(int(t[i]), "us").astype("datetime64[s]")).replace("T", " ")  # noqa: B023, E731
        breaks = np.flatnonzero(np.diff(t) > 14400e6) + 1
        for s, e in zip(np.r_[0, breaks], np.r_[breaks, len(t)]):
            stops = [(s + a, s + b) for a, b in stretches(t[s:e], la[s:e], lo[s:e])]
            assert all(b < c for (_, b), (c, _) in zip(stops, stops[1:])), "stretches overlap: the tables have no such case"
            prev = s
            for a, b in stops:
                out.add((k, "stop", text(a), text(b)))
                if t[prev] < t[a]:
                    out.add((k, "trip", text(prev), text(a)))
                prev = b
            if t[prev] < t[e - 1]:
                out.add((k, "trip", text(prev), text(e - 1)))
    return out
