"""Irregular readings onto a regular grid: a Kalman smoother with a continuous-time local trend.

Each source's coordinates follow a local linear trend in continuous time (integrated random walk on the slope)
and are read with noise. A forward Kalman filter over the merged times of readings and grid points and a
backward Rauch-Tung-Striebel pass give position and standard deviation at every grid time; periods without a
reading are filled and marked.

The table lies in even blocks by (source, time). Each block sums up its first and its last source exactly: what the
readings make of the state before them (a conditional Gaussian) and how likely they are given it. The driver combines
these in order, so a block starts from the filter's state after all earlier readings of its source and ends with the
likelihood of all later ones, however dense they are; a period cut by a block's edge is counted the same way. All
sources of a block are smoothed side by side in numpy, step by step; a long source is cut into pieces that are smoothed
side by side, so a block with one source costs no more steps than one with hundreds.

Defined results: rows without source, time or one of the coordinates (null, NaN) are no readings; readings of
one source at one time count with their mean; a source with one reading gives one period; an empty table none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.npgeo import text_time
from pathloom.functions.times import micros
from pathloom.operators.blocks import BLOCK, ROWS_PER_BLOCK, OrderedBlocks

_REPORT = "k string, t0 long, t1 long, lat double, lon double, lon1 double, turn double, e array<double>, slot long, n long, whole boolean, _side string"
_OUT = "traj_id string, slot string, missing boolean, n_readings long, lat double, lon double, lat_sd double, lon_sd double"


def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("nij,ndj->ndi", m, v)


def _combine(i: tuple, j: tuple) -> tuple:
    """Stretches ``i`` and then ``j``. A stretch is ``(A, b, C, h, J)``: the state after it is normal around ``A x + b``
    with covariance ``C`` given the state ``x`` before it, its readings have likelihood ``exp(h x - x J x / 2)``."""
    (a1, b1, c1, h1, j1), (a2, b2, c2, h2, j2) = i, j
    d = np.linalg.inv(np.eye(2) + c1 @ j2)
    on, back = a2 @ d, np.swapaxes(d @ a1, 1, 2)
    return on @ a1, _apply(on, b1 + _apply(c1, h2)) + b2, on @ c1 @ np.swapaxes(a2, 1, 2) + c2, _apply(back, h2 - _apply(j2, b1)) + h1, back @ j2 @ a1 + j1


def _moved(hours: np.ndarray, process: float) -> tuple:
    """Stretches without a reading."""
    d, n = hours, len(hours)
    f = np.tile(np.eye(2), (n, 1, 1))
    f[:, 0, 1] = d
    q = process * np.stack([np.stack([d**3 / 3, d**2 / 2], 1), np.stack([d**2 / 2, d], 1)], 1)
    return f, np.zeros((n, 2, 2)), q, np.zeros((n, 2, 2)), np.zeros((n, 2, 2))


def _read(y: np.ndarray, noise: float) -> tuple:
    """Readings ``y`` (n x coordinates) of the state itself."""
    n = len(y)
    h, j = np.zeros((n, 2, 2)), np.zeros((n, 2, 2))
    h[:, :, 0], j[:, 0, 0] = y / noise, 1 / noise
    return np.tile(np.eye(2), (n, 1, 1)), np.zeros((n, 2, 2)), np.zeros((n, 2, 2)), h, j


def _summed(hours: np.ndarray, y: np.ndarray, process: float, noise: float) -> tuple:
    """Readings in order as one stretch, from the time of the first to the time of the last."""
    e = _combine(_moved(np.diff(hours, prepend=hours[:1]), process), _read(y, noise))
    while len(e[0]) > 1:
        m = len(e[0]) // 2 * 2
        two = _combine(tuple(x[0:m:2] for x in e), tuple(x[1:m:2] for x in e))
        e = tuple(np.concatenate([x, rest[m:]]) for x, rest in zip(two, e))
    return e


def _at_times(block: pd.DataFrame) -> pd.DataFrame:
    """One row ``k, t, lat, lon, n`` for each source and time: the mean of its readings and their number."""
    k, t, lon = (block[c].to_numpy() for c in ("k", "t", "lon"))
    new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(block)])
    of = np.repeat(lon[first], n)
    mean_lon = lon[first] + np.add.reduceat((lon - of + 180) % 360 - 180, first) / n
    return pd.DataFrame({"k": k[first], "t": t[first], "lat": np.add.reduceat(block["lat"].to_numpy(), first) / n, "lon": mean_lon, "n": n})


def _flat_lon(lon: np.ndarray) -> np.ndarray:
    """Degrees east of the first, along the shortest way between successive readings."""
    return np.cumsum(np.r_[0.0, (np.diff(lon) + 180) % 360 - 180])


_PRIOR = np.array([[1e4, 0.0], [0.0, 1e2]])  # wide


def smooth(
    times: np.ndarray, values: np.ndarray, valid: np.ndarray, process: float, noise: float, before: list | None = None, after: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed values and variances. ``times``: sources x steps (hours, ascending), ``values``: sources x steps x
    coordinates with NaN where only the grid asks; ``valid``: which steps exist (at the front of each row).
    ``before``: (row, mean, covariance) of states known at a row's first step; ``after``: (row, h, J) of the
    likelihood of what follows its last step."""
    n, steps, dims = values.shape
    m = np.zeros((n, dims, 2))
    first = np.argmax(~np.isnan(values[:, :, 0]), axis=1)
    m[:, :, 0] = values[np.arange(n), first]
    p = np.tile(_PRIOR, (n, 1, 1))
    for i, mean, covariance in before or []:
        m[i], p[i] = mean, covariance
    ms, ps = np.zeros((steps, n, dims, 2)), np.zeros((steps, n, 2, 2))
    mp, pp = np.zeros((steps, n, dims, 2)), np.zeros((steps, n, 2, 2))
    gaps = np.diff(times, axis=1, prepend=times[:, :1])
    gaps = np.where(valid, gaps, 0.0)

    def move(p, d):
        q = np.empty_like(p)
        q[:, 0, 0] = p[:, 0, 0] + 2 * d * p[:, 0, 1] + d * d * p[:, 1, 1] + process * d**3 / 3
        q[:, 0, 1] = q[:, 1, 0] = p[:, 0, 1] + d * p[:, 1, 1] + process * d**2 / 2
        q[:, 1, 1] = p[:, 1, 1] + process * d
        return q

    for s in range(steps):
        d = gaps[:, s]
        m = np.stack([m[:, :, 0] + d[:, None] * m[:, :, 1], m[:, :, 1]], axis=2)
        p = move(p, d)
        mp[s], pp[s] = m, p
        seen = ~np.isnan(values[:, s, 0]) & valid[:, s]
        gain = p[:, :, 0] / (p[:, 0, 0] + noise)[:, None]
        gain = np.where(seen[:, None], gain, 0.0)
        gap = np.where(seen[:, None], values[:, s] - m[:, :, 0], 0.0)
        m = m + gap[:, :, None] * gain[:, None, :]
        p = p - gain[:, :, None] * p[:, None, 0, :]
        ms[s], ps[s] = m, p
    out, var = np.empty((n, steps, dims)), np.empty((n, steps))
    m, p = ms[-1].copy(), ps[-1].copy()
    for i, h, j in after or []:
        d = np.linalg.inv(np.eye(2) + p[i] @ j)
        m[i], p[i] = (m[i] + h @ p[i]) @ d.T, d @ p[i]
    out[:, -1], var[:, -1] = m[:, :, 0], p[:, 0, 0]
    for s in range(steps - 2, -1, -1):
        d = gaps[:, s + 1]
        cross = np.stack([np.stack([ps[s][:, 0, 0] + d * ps[s][:, 0, 1], ps[s][:, 0, 1]], 1), np.stack([ps[s][:, 0, 1] + d * ps[s][:, 1, 1], ps[s][:, 1, 1]], 1)], 1)
        q = pp[s + 1]
        det = q[:, 0, 0] * q[:, 1, 1] - q[:, 0, 1] ** 2
        det = np.where(np.abs(det) < 1e-300, 1e-300, det)
        inv = np.stack([np.stack([q[:, 1, 1], -q[:, 0, 1]], 1), np.stack([-q[:, 0, 1], q[:, 0, 0]], 1)], 1) / det[:, None, None]
        g = np.where((d == 0)[:, None, None], np.eye(2), cross @ inv)
        m = ms[s] + np.einsum("nij,ndj->ndi", g, m - mp[s + 1])
        p = ps[s] + g @ (p - q) @ np.swapaxes(g, 1, 2)
        out[:, s], var[:, s] = m[:, :, 0], p[:, 0, 0]
    return out, np.maximum(var, 0.0)


LONG, PIECE = 1024, 256  # steps from which one source is cut, and steps of a piece


def smooth_long(hours: np.ndarray, y: np.ndarray, process: float, noise: float, before: tuple | None = None, after: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``smooth`` of one long source (``hours``: steps, ``y``: steps x coordinates), by pieces side by side.

    All pieces are summed up at once, as blocks are; the sums give each piece the filter's state before it and the
    likelihood of what follows, and then all pieces are smoothed at once.
    """
    m = len(hours)
    n = -(-m // PIECE)
    seen = ~np.isnan(y[:, 0])
    e = _combine(_moved(np.diff(hours, prepend=hours[:1]), process), _read(np.where(seen[:, None], y, 0.0), noise))
    rest = _moved(np.diff(hours, prepend=hours[:1]), process)
    e = tuple(np.where(seen[:, None, None], a, b) for a, b in zip(e, rest))
    nothing = _moved(np.zeros(1), process)
    sums = tuple(np.concatenate([x, np.repeat(z, n * PIECE - m, axis=0)]).reshape(n, PIECE, 2, 2) for x, z in zip(e, nothing))
    while sums[0].shape[1] > 1:  # neighbours meet
        left, right = (tuple(x[:, k::2].reshape(-1, 2, 2) for x in sums) for k in (0, 1))
        sums = tuple(x.reshape(n, -1, 2, 2) for x in _combine(left, right))
    of = lambda p: tuple(x[p] for x in sums)
    zero = np.zeros((1, 2, 2))
    if before is None:
        mean = np.zeros((1, 2, 2))
        mean[0, :, 0] = y[np.argmax(seen)] if seen.any() else 0.0
        before = (mean[0], _PRIOR)
    states, state = [before], (zero, np.asarray(before[0])[None], np.asarray(before[1])[None], zero, zero)
    for p in range(n - 1):
        state = _combine(state, of(p))
        states.append((state[1][0], state[2][0]))
    ends, follow = [None] * n, after
    for p in range(n - 1, -1, -1):
        ends[p] = follow
        own = of(p) if follow is None else _combine(of(p), (zero, zero, zero, follow[0][None], follow[1][None]))
        follow = (own[3][0], own[4][0])
    at = np.minimum(np.arange(n)[:, None] * PIECE + np.arange(-1, PIECE), m - 1)
    at[0, 0] = 0  # each piece begins at the last step before it, whose state is known
    valid = np.arange(n)[:, None] * PIECE + np.arange(-1, PIECE) < m
    values = y[at]
    values[:, 0] = np.nan
    out, var = smooth(hours[at], np.where(valid[:, :, None], values, np.nan), valid, process, noise, [(p, *s) for p, s in enumerate(states)], [(p, *f) for p, f in enumerate(ends) if f is not None])
    keep = valid[:, 1:]
    return out[:, 1:][keep], var[:, 1:][keep]


def regular_grid(
    df: DataFrame,
    period_s: int = 21600,
    key: str = "traj_id",
    time: str = "DateTime",
    lat: str = "lat",
    lon: str = "lon",
    row_id: str = "row_id",
    process: float = 1e-3,
    noise: float = 4e-4,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``traj_id, slot, missing, n_readings, lat, lon, lat_sd, lon_sd``: one row per period (start included, end not,
    counted from 1970) between a source's first and last period with a reading, evaluated at the period's start.

    ``process``: variance of the slope's change in degrees^2 per hour^3; ``noise``: variance of a reading in degrees^2.
    Longitudes are smoothed along the shortest way between successive readings and returned in -180..180.
    """
    step = period_s * 1_000_000
    good = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")) & F.col(key).isNotNull() & F.col(time).isNotNull()
    rows = df.where(good).select(F.col(key).cast("string").alias("k"), micros(time).alias("t"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(row_id).alias("r"))
    blocks = OrderedBlocks(rows, ["k", "t"], ["r"], keep=["k", "t", "lat", "lon"], rows_per_block=rows_per_block)

    def report(block: pd.DataFrame) -> pd.DataFrame:
        x, out = _at_times(block), []
        k, slot, n = x["k"].to_numpy(), x["t"].to_numpy() // step, x["n"].to_numpy()
        for side, at in (("a", 0), ("z", -1)):
            mine = x[k == k[at]]
            t, la, lo = (mine[c].to_numpy() for c in ("t", "lat", "lon"))
            flat = _flat_lon(lo)
            e = _summed((t - t[0]) / 3.6e9, np.c_[la - la[0], flat], process, noise)
            same = (k == k[at]) & (slot == slot[at])
            out.append({"k": k[at], "t0": t[0], "t1": t[-1], "lat": la[0], "lon": lo[0], "lon1": lo[-1], "turn": flat[-1], "e": np.concatenate([v.ravel() for v in e]).tolist(), "slot": slot[at], "n": int(n[same].sum()), "whole": bool(same.all()), "_side": side})
        return pd.DataFrame(out)

    reports = blocks.reports(report, _REPORT)
    ends = [(int(b), *g.to_dict("records")) for b, g in reports.groupby(BLOCK)]
    stretch = lambda r: tuple(np.asarray(r["e"], float).reshape(5, 1, 2, 2))
    hours = lambda us: np.array([us / 3.6e9])

    def shift(r: dict, q: dict) -> np.ndarray:
        """Places are counted from a block's first reading of the source: what to add from one block to the next."""
        return np.array([r["lat"] - q["lat"], -(r["turn"] + (q["lon"] - r["lon1"] + 180) % 360 - 180)])

    before: dict[int, tuple] = {}  # time and state after the last reading of earlier blocks, in the block's own terms
    after: dict[int, tuple] = {}  # likelihood of the readings of later blocks
    extra: dict[int, int] = {}  # readings of later blocks in the block's last period
    state = None
    for i, (b, head, tail) in enumerate(ends):
        if i and ends[i - 1][2]["k"] == head["k"]:
            last = ends[i - 1][2]
            mean = state[1].copy()
            mean[0, :, 0] += shift(last, head)
            before[b] = (last["t1"], mean[0], state[2][0])
        if head["k"] == tail["k"] and b in before:
            start, since = (np.zeros((1, 2, 2)), before[b][1][None], before[b][2][None]), tail["t0"] - before[b][0]
        else:
            start, since = (np.zeros((1, 2, 2)), np.zeros((1, 2, 2)), _PRIOR[None]), tail["t0"] % step
        state = _combine(_combine((*start, np.zeros((1, 2, 2)), np.zeros((1, 2, 2))), _moved(hours(since), process)), stretch(tail))
    for i in range(len(ends) - 2, -1, -1):
        (b, _, tail), (c, head, tail_next) = ends[i], ends[i + 1]
        if tail["k"] == head["k"]:
            e = stretch(head)
            if head["k"] == tail_next["k"] and c in after:
                e = _combine(e, (np.zeros((1, 2, 2)),) * 3 + tuple(x[None] for x in after[c]))
            h, j = e[3].copy(), e[4]
            h[0] -= shift(tail, head)[:, None] * j[0][0]  # from the next block's terms
            e = _combine(_moved(hours(head["t0"] - tail["t1"]), process), (e[0], e[1], e[2], h, j))
            after[b] = (e[3][0], e[4][0])
            if tail["slot"] == head["slot"]:
                extra[b] = head["n"] + (extra.get(c, 0) if head["whole"] else 0)

    def work(block: pd.DataFrame, number: int) -> pd.DataFrame:
        x = _at_times(block)
        k, t = x["k"].to_numpy(), x["t"].to_numpy()
        src = np.r_[0, np.cumsum(k[1:] != k[:-1])]
        n = src[-1] + 1
        name = k[np.r_[True, k[1:] != k[:-1]]]
        slot = t // step
        # a block answers for the periods after the last one before it up to its own last reading
        start = np.searchsorted(src, np.arange(n))
        begin, last_own = slot[start], slot[np.r_[start[1:], len(x)] - 1]
        entry = before.get(number)
        if entry:
            begin[0] = entry[0] // step + 1
        count = np.maximum(last_own - begin + 1, 0)
        g_src = np.repeat(np.arange(n), count)
        g_slot = np.arange(len(g_src)) - np.repeat(np.cumsum(count) - count, count) + begin[g_src]
        lon_flat = _flat_lon(x["lon"].to_numpy())
        at = np.c_[x["lat"].to_numpy() - x["lat"].to_numpy()[start][src], lon_flat - lon_flat[start][src]]
        # readings and grid times of each source in one line; a reading at a grid time comes first
        s_all = np.r_[src, g_src, [0] * bool(entry)].astype(int)
        t_all = np.r_[t, g_slot * step, [entry[0]] if entry else []].astype("int64")
        is_grid = np.r_[np.zeros(len(at), bool), np.ones(len(s_all) - len(at), bool)]
        order = np.lexsort((is_grid, t_all, s_all))
        s_o, t_o, grid_o = s_all[order], t_all[order], is_grid[order]
        val = np.full((len(order), 2), np.nan)
        val[~grid_o] = at[order[~grid_o]]
        est, sd = np.empty((len(order), 2)), np.empty(len(order))
        length = np.bincount(s_o, minlength=n)
        base = np.cumsum(length) - length
        # sources of similar length side by side, so that padding stays small
        by_len = np.argsort(length, kind="stable")
        p = 0
        while p < n:
            if length[by_len[p]] > LONG:
                i = int(by_len[p])
                line = slice(base[i], base[i] + length[i])
                est[line], got = smooth_long((t_o[line] - t_o[base[i]]) / 3.6e9, val[line], process, noise, entry[1:] if entry and i == 0 else None, after.get(number) if i == n - 1 else None)
                sd[line] = np.sqrt(got)
                p += 1
                continue
            q = p + 1
            while q < n and length[by_len[q]] <= 1.5 * length[by_len[p]] + 8 and (q - p) * length[by_len[q]] < 400_000:
                q += 1
            some = by_len[p:q]
            width = int(length[some].max())
            col = np.arange(width)
            valid = col < length[some][:, None]
            idx = base[some][:, None] + np.minimum(col, length[some][:, None] - 1)
            since = (t_o[idx] - t_o[base[some]][:, None]) / 3.6e9
            got, var = smooth(
                since, np.where(valid[:, :, None], val[idx], np.nan), valid, process, noise,
                [(i, *entry[1:]) for i in np.flatnonzero(some == 0)] if entry else None,
                [(i, *after[number]) for i in np.flatnonzero(some == n - 1)] if number in after else None,
            )
            est[idx[valid]], sd[idx[valid]] = got[valid], np.sqrt(var[valid])
            p = q
        back = np.empty(len(order), int)
        back[order] = np.arange(len(order))
        g_at = back[len(at) : len(at) + len(g_src)]
        pos = est[g_at] + x[["lat", "lon"]].to_numpy()[start][g_src]
        readings = x["n"].groupby([src, slot]).sum()
        n_in = readings.reindex(pd.MultiIndex.from_arrays([g_src, g_slot])).fillna(0).to_numpy().astype("int64") if len(g_src) else np.empty(0, "int64")
        if number in extra:
            n_in[(g_src == n - 1) & (g_slot == slot[-1])] += extra[number]
        return pd.DataFrame({
            "traj_id": name[g_src], "slot": text_time(g_slot * step), "missing": n_in == 0, "n_readings": n_in,
            "lat": pos[:, 0], "lon": (pos[:, 1] + 180) % 360 - 180, "lat_sd": sd[g_at], "lon_sd": sd[g_at],
        })

    return blocks.map(work, _OUT)
