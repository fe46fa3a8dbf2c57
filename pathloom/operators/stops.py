"""Stops and trips from noisy location pings (hidden semi-Markov decoding).

1. Pings are ordered by (key, time) in even blocks (``blocks.py``), so an animal with a third of all pings is
   spread over many tasks.
2. Emissions: each ping is linked to all of the next ``max_elsewhere + 1`` pings of its session that could share
   its place (at most twice the radius away). Linked pings form a component; up to ``max_elsewhere`` pings elsewhere
   are bridged. A component that fits a circle of the radius (smallest enclosing circle) is a dwell, another is
   cut into dwells where the place is left.
3. Decoding: states are stop and travel, with emissions for every ping (under stop a Gaussian around the dwell's mean,
   under travel anywhere in ``TRAVEL_KM2``) and explicit duration distributions (``Durations``). A stop's duration has
   no mass below ``min_stop_s``; travel is log-normal with a point mass at zero (one stop next to another) and is
   censored at the ends of a stretch of overlapping dwells. Viterbi runs over segment ends: a stop segment is a
   dwell or, where dwells overlap, a dwell cut at its rival's edge; all predecessors compete (those that cannot win
   any more are passed over by a bound). What is no stop for certain (a single dwell without rival is one by
   definition) is decided by it.
4. Parts of components that touch a block's edge (at most ``max_elsewhere + 1`` per side and block), and dwells whose
   pings lie between theirs, reach the driver with their convex hulls and are joined there. A joined component that fits the circle and overlaps no other dwell
   is a stop. The pings of all others are brought together, one group per stretch of overlapping components, and cut
   and decoded by the same functions as inside a block, so results do not depend on where blocks are cut.
5. Silences over ``session_gap_s`` split sessions before path totals. Path lengths are differences of a running
   length per key, carried from block to block. Trips lie between successive marks (begin of a session, stop, end of a
   session), which are put in order in even blocks as well.

Defined results: pings without key, time or coordinate do not count (NaN is no coordinate); of several pings of
a key at one time the one with the smallest row id counts; an empty table gives no rows; a session of a single
ping gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.npgeo import haversine_m, text_time
from pathloom.functions.times import micros
from pathloom.operators.blocks import BLOCK, ROWS_PER_BLOCK, OrderedBlocks, edges, halos, reliable

_EDGE = "k string, t long, lat double, lon double, path double, one boolean, size long, _side string"
_EVENT = (
    "k string, kind int, t0 long, t1 long, c0 double, c1 double, n long, "
    "block int, unit int, into array<long>, heads array<long>, hla array<double>, hlo array<double>"
)
_KNOT = "k string, g long, m long, t long, lat double, lon double, c double, at long"
_START, _STOP, _END, _OPEN = 0, 1, 2, 3

PLACE_M, TRAVEL_KM2, LOG_ELSEWHERE = 10.0, 100.0, math.log(0.05)
_LOG_ODDS = math.log(TRAVEL_KM2 * 1e6) - math.log(2 * math.pi * PLACE_M**2)


@dataclass(frozen=True)
class Durations:
    """Log-normal durations in minutes (median, sigma) of stops and travel, and the chance that a stop follows a stop at
    once."""

    stop_min: float = 90.0
    stop_sigma: float = 2.0
    travel_min: float = 30.0
    travel_sigma: float = 2.0
    p_direct: float = 0.05

    def stop(self, us: int) -> float:
        return _log_normal(us / 60e6, self.stop_min, self.stop_sigma)

    def travel(self, us: int) -> float:
        """Log density of a travel between two stops."""
        if us <= 0:
            return math.log(self.p_direct)
        return math.log(1 - self.p_direct) + _log_normal(us / 60e6, self.travel_min, self.travel_sigma)

    def travel_at_least(self, us: int) -> float:
        """Of a travel at an end, only its survival is known."""
        if us <= 0:
            return 0.0
        z = (math.log(us / 60e6) - math.log(self.travel_min)) / self.travel_sigma
        return math.log(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12))

    def travel_at_most(self) -> float:
        """The largest log density of any travel."""
        mode = math.exp(math.log(self.travel_min) - self.travel_sigma**2)
        return max(math.log(self.p_direct), self.travel(int(max(mode, 1e-3) * 60e6)), self.travel(1))


def _log_normal(minutes: float, median: float, sigma: float) -> float:
    z = (math.log(max(minutes, 1e-3)) - math.log(median)) / sigma
    return -0.5 * z * z - math.log(sigma * max(minutes, 1e-3) * math.sqrt(2 * math.pi))


def _evidence(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Log odds of each ping of a dwell under stop against travel."""
    x, y = _flat(lat, lon, lat[0], lon[0])
    return _LOG_ODDS - ((x - x.mean()) ** 2 + (y - y.mean()) ** 2) / (2 * PLACE_M**2)


def decode(units: list[dict], begin: int, end: int, min_us: int, durations: Durations = Durations()) -> list[dict]:
    """Viterbi over stop segments of one stretch of a session.

    ``units``: dwells with ``t0 t1``, the times ``at`` of their pings, the pings' log odds ``odds`` and the number ``out``
    of pings elsewhere within.
    """
    units = [u for u in units if u["t1"] - u["t0"] >= min_us]
    units.sort(key=lambda u: (u["t0"], -u["t1"]))
    kept: list[dict] = []
    for u in units:  # a dwell within a longer one is an excursion from it
        if not (kept and u["t1"] <= kept[-1]["t1"]):
            kept.append(u)
    segments = []
    for i, u in enumerate(kept):
        at, upto = u["at"], np.r_[0.0, np.cumsum(u["odds"])]
        los, his = [0], [len(at)]
        if i and kept[i - 1]["t1"] >= u["t0"]:
            los.append(int(np.searchsorted(at, kept[i - 1]["t1"], side="right")))
        if i + 1 < len(kept) and kept[i + 1]["t0"] <= u["t1"]:
            his.append(int(np.searchsorted(at, kept[i + 1]["t0"])))
        for lo in los:
            for hi in his:
                if hi > lo and at[hi - 1] - at[lo] >= min_us:
                    score = durations.stop(int(at[hi - 1] - at[lo])) + float(upto[hi] - upto[lo]) + LOG_ELSEWHERE * u.get("out", 0)
                    segments.append((int(at[lo]), int(at[hi - 1]), hi - lo, score, u))
    segments.sort(key=lambda s: (s[1], s[0]))
    best: list[float] = []
    back: list[int] = []
    upto_best: list[float] = []  # the best of the segments so far
    most = durations.travel_at_most()
    top, last = durations.travel_at_least(end - begin), -1
    for i, (t0, t1, _, score, _) in enumerate(segments):
        value, came = durations.travel_at_least(t0 - begin), -1
        for j in range(i - 1, -1, -1):
            if upto_best[j] + most <= value:  # none of the earlier ones can win
                break
            if segments[j][1] < t0:
                v = best[j] + durations.travel(t0 - segments[j][1])
                if v > value:
                    value, came = v, j
        best.append(value + score)
        back.append(came)
        upto_best.append(max(best[i], upto_best[-1] if i else -math.inf))
        v = best[i] + durations.travel_at_least(end - t1)
        if v > top:
            top, last = v, i
    chosen = []
    while last >= 0:
        t0, t1, n, _, u = segments[last]
        chosen.append(u | {"t0": t0, "t1": t1, "n": n})
        last = back[last]
    return chosen[::-1]


_DEGREE_M = math.radians(6_371_000.0)


def _flat(lat: np.ndarray, lon: np.ndarray, la0: float, lo0: float) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of a place nearby, the short way round."""
    return ((lon - lo0 + 180) % 360 - 180) * (math.cos(math.radians(la0)) * _DEGREE_M), (lat - la0) * _DEGREE_M


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull. Points within the polygon of the furthest in 32 directions are left out first."""
    at = np.arange(len(x))
    if len(x) > 64:
        turn = np.arange(32) * (2 * np.pi / 32)
        far = [int((math.cos(a) * x + math.sin(a) * y).argmax()) for a in turn]
        far = [f for f, g in zip(far, far[-1:] + far[:-1]) if f != g]
        within = np.full(len(x), len(far) > 2)
        for f, g in zip(far, far[1:] + far[:1]):
            within &= (x[g] - x[f]) * (y - y[f]) - (y[g] - y[f]) * (x - x[f]) > 0
        at = np.flatnonzero(~within)
    points = sorted({(float(x[i]), float(y[i])): int(i) for i in at}.items())
    if len(points) < 3:
        return np.array([i for _, i in points])
    rims = []
    for line in (points, points[::-1]):
        rim: list = []
        for q in line:
            while len(rim) > 1 and (rim[-1][0][0] - rim[-2][0][0]) * (q[0][1] - rim[-2][0][1]) - (rim[-1][0][1] - rim[-2][0][1]) * (q[0][0] - rim[-2][0][0]) <= 0:
                rim.pop()
            rim.append(q)
        rims += rim[:-1]
    return np.array([i for _, i in rims])


def _circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Smallest enclosing circle of a few points: centre and radius (incremental)."""
    p = list(zip(x.tolist(), y.tolist()))
    p = [p[i] for i in np.random.default_rng(0).permutation(len(p))]

    def out(c, q):
        return math.hypot(q[0] - c[0], q[1] - c[1]) > c[2] + 1e-9

    def two(a, b):
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.hypot(a[0] - b[0], a[1] - b[1]) / 2

    def three(a, b, c):
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:  # in a line
            return max((two(a, b), two(a, c), two(b, c)), key=lambda t: t[2])
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return a[0] + ux, a[1] + uy, math.hypot(ux, uy)

    c = (*p[0], 0.0)
    for i in range(1, len(p)):
        if out(c, p[i]):
            c = (*p[i], 0.0)
            for j in range(i):
                if out(c, p[j]):
                    c = two(p[i], p[j])
                    for m in range(j):
                        if out(c, p[m]):
                            c = three(p[i], p[j], p[m])
    return c


def _fits(lat: np.ndarray, lon: np.ndarray, radius: float) -> bool:
    """Whether a circle of the radius holds all points."""
    x, y = _flat(lat, lon, lat[0], lon[0])
    if max(np.ptp(x), np.ptp(y)) > 2 * radius + 1e-6:
        return False
    if np.hypot(x - x.mean(), y - y.mean()).max() <= radius:
        return True
    h = _hull(x, y)
    return _circle(x[h], y[h])[2] <= radius + 1e-6


def _by_place(lat: np.ndarray, lon: np.ndarray, radius: float, max_elsewhere: int) -> list[np.ndarray]:
    """Cuts a component whose place drifts: longest stretches from the left that a circle of the radius holds."""
    out, start, n = [], 0, len(lat)
    while start < n:
        took, missed, at, step = [np.array([start])], 0, start + 1, 16
        last, cx, cy, r = start, 0.0, 0.0, 0.0
        px, py = np.zeros(1), np.zeros(1)  # what the circle has to hold
        while at < n and missed <= max_elsewhere:
            x, y = _flat(lat[at : at + step], lon[at : at + step], lat[start], lon[start])
            d = np.hypot(x - cx, y - cy)
            outside = np.flatnonzero(d > r + 1e-6)
            f = int(outside[0]) if len(outside) else len(x)
            if f:
                took.append(np.arange(at, at + f))
                px, py = np.r_[px, x[:f]], np.r_[py, y[:f]]
                last, missed = at + f - 1, 0
                if len(px) > 4096:
                    h = _hull(px, py)
                    px, py = px[h], py[h]
            at += f
            if f == len(x):
                step = min(2 * step, 2048)
                continue
            step, grown = 16, None
            if d[f] ** 2 + r * r <= 4 * radius * radius + 1e-3:  # else some held point is too far from this one
                h = _hull(px, py)
                px, py = px[h], py[h]
                grown = _circle(np.r_[px, x[f]], np.r_[py, y[f]])
            if grown is not None and grown[2] <= radius + 1e-6:
                cx, cy, r = grown
                px, py = np.r_[px, x[f]], np.r_[py, y[f]]
                took.append(np.array([at]))
                last, missed = at, 0
            else:
                missed += 1
            at += 1
        out.append(np.concatenate(took))
        start = last + 1
    return out


def _components(near: list[np.ndarray], n: int) -> np.ndarray:
    """Labels of connected rows; ``near[d - 1][i]``: whether rows ``i`` and ``i + d`` are linked."""
    root = np.arange(n)
    for d in range(len(near), 0, -1):
        i = np.flatnonzero(near[d - 1])
        root[i] = i + d
    while True:
        nxt = root[root]
        if np.array_equal(nxt, root):
            break
        root = nxt
    pairs = [np.c_[root[i], root[i + d]] for d in range(2, len(near) + 1) for i in [np.flatnonzero(near[d - 1])]]
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    if len(pairs):
        parent: dict[int, int] = {}
        for a, b in pairs.tolist():
            a, b = _find(parent, a), _find(parent, b)
            if a != b:
                parent[a] = b
        label = np.arange(n)
        for a in list(parent):
            label[a] = _find(parent, a)
        root = label[root]
    return root


def _find(parent: dict[int, int], i: int) -> int:
    top = i
    while top in parent:
        top = parent[top]
    while i != top:
        parent[i], i = top, parent[i]
    return top


def _stretches(units: list[dict]) -> list[list[dict]]:
    """Units grouped where they overlap in time."""
    out: list[list[dict]] = []
    top = None
    for u in sorted(units, key=lambda u: (u["t0"], u["t1"])):
        if top is not None and u["t0"] <= top:
            out[-1].append(u)
            top = max(top, u["t1"])
        else:
            out.append([u])
            top = u["t1"]
    return out


def _decoded(units: list[dict], min_us: int, durations: Durations) -> list[dict]:
    return [c for us in _stretches(units) for c in decode(us, us[0]["t0"], max(u["t1"] for u in us), min_us, durations)]


def _dedupe(block: pd.DataFrame) -> pd.DataFrame:
    k, t = block["k"].to_numpy(), block["t"].to_numpy()
    first = np.ones(len(block), bool)
    first[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return block[first].reset_index(drop=True)


def _steps(k, lat, lon) -> np.ndarray:
    """Metres from the row before, 0 at a key's first row."""
    step = np.zeros(len(k))
    if len(k) > 1:
        step[1:] = np.where(k[1:] == k[:-1], haversine_m(lat[:-1], lon[:-1], lat[1:], lon[1:]), 0.0)
    return step


def stops_and_trips(
    df: DataFrame,
    key: str = "traj_id",
    time: str = "DateTime",
    lat: str = "lat",
    lon: str = "lon",
    row_id: str = "row_id",
    radius_m: float = 30.0,
    min_stop_s: int = 1200,
    session_gap_s: int = 14400,
    max_elsewhere: int = 3,
    durations: Durations = Durations(),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``traj_id, kind (stop|trip), start_at, end_at, duration_s, distance_m``; see the module for definitions."""
    reach, gap_us, min_us = max_elsewhere + 1, session_gap_s * 1_000_000, min_stop_s * 1_000_000
    good = ~(F.isnan(lat) | F.isnan(lon)) & F.col(key).isNotNull() & F.col(time).isNotNull()
    pings = df.where(good & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(key).cast("string").alias("k"), micros(time).alias("t"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(row_id).alias("r")
    )
    blocks = OrderedBlocks(pings, ["k", "t"], ["r"], keep=["k", "t", "lat", "lon"], rows_per_block=rows_per_block)

    def report(block: pd.DataFrame) -> pd.DataFrame:
        d = _dedupe(block)
        k = d["k"].to_numpy()
        mine = k == k[-1]
        out = edges(d[["k", "t", "lat", "lon"]], reach)
        out["path"] = float(_steps(k, d["lat"].to_numpy(), d["lon"].to_numpy())[mine].sum())
        out["one"], out["size"] = bool(mine.all()), len(d)
        return out[["k", "t", "lat", "lon", "path", "one", "size", "_side"]]

    reports = blocks.reports(report, _EDGE)
    around = halos(reports[[BLOCK, "k", "t", "lat", "lon", "_side"]], reach)
    carry: dict[int, float] = {}
    before, offset, rows_before = None, {}, 0
    for b, g in reports.groupby(BLOCK):
        head, tail = g[g["_side"] == "a"].iloc[0], g[g["_side"] == "z"].iloc[-1]
        carry[int(b)] = 0.0
        if before is not None and before["k"] == head["k"]:
            step = float(haversine_m(before["lat"], before["lon"], head["lat"], head["lon"]))
            carry[int(b)] = (carry[before["b"]] if before["one"] else 0.0) + before["path"] + step
        before = tail.to_dict() | {"b": int(b)}
        offset[int(b)] = rows_before
        rows_before += int(head["size"])

    def parts(block: pd.DataFrame, number: int):
        """A block's rows with their neighbours, its stops' candidates and what other blocks have to say about."""
        own = _dedupe(block)[["k", "t", "lat", "lon"]]
        lead, trail = around[number]
        x = pd.concat([lead, own, trail], ignore_index=True)
        k, t, la, lo = x["k"].to_numpy(), x["t"].to_numpy(), x["lat"].to_numpy(), x["lon"].to_numpy()
        a, z, n = len(lead), len(lead) + len(own), len(x)
        step = _steps(k, la, lo)
        step[a] = 0.0
        cum = np.zeros(n)
        cum[a:z] = np.cumsum(step[a:z])
        new_key = np.ones(n, bool)
        new_key[1:] = k[1:] != k[:-1]
        starts = np.flatnonzero(new_key & (np.arange(n) > a))
        base = np.zeros(n)  # the running length at each key's first row in this block
        for s, e in zip(starts, [*starts[1:], n]):
            base[s:e] = cum[s] if s < n else 0
        cum = cum - base
        first_key_end = starts[0] if len(starts) else n
        cum[:first_key_end] += carry[number]
        brk = new_key.copy()
        brk[1:] |= (t[1:] - t[:-1]) > gap_us
        sess = np.cumsum(brk)
        near, heads, into, spans = [], [], [], []
        for d in range(1, reach + 1):
            i = np.arange(max(n - d, 0))
            ok = (sess[i] == sess[i + d]) & (haversine_m(la[i], lo[i], la[i + d], lo[i + d]) <= 2 * radius_m)
            i = i[ok]
            heads.append(i[(i < a) & (i + d >= a) & (i + d < z)] + d)
            into.append(np.c_[i, i + d][(i >= a) & (i < z) & (i + d >= z)])
            inner = np.zeros(z - a, bool)
            inner[i[(i >= a) & (i + d < z)] - a] = True
            near.append(inner)
            spans += [(int(s), -math.inf, math.inf) for s in sess[i[(i < a) & (i + d >= z)]]]  # over a block of a few rows
        heads, into = np.unique(np.concatenate(heads)), np.concatenate(into)
        root = _components(near, z - a) + a
        order = np.argsort(root, kind="stable") + a
        cuts = np.flatnonzero(np.diff(root[order - a])) + 1
        lo_of, hi_of = np.r_[0, cuts], np.r_[cuts, len(order)]
        i0, i1 = order[lo_of], order[hi_of - 1]
        from_before, to_after = np.isin(root[i0 - a], root[heads - a]), np.isin(root[i0 - a], root[into[:, 0] - a])
        opens, units = [], []
        # only what may become a stop is looked at ping by ping
        for g in np.flatnonzero(from_before | to_after | ((t[i1] - t[i0]) >= min_us)):
            idx = order[lo_of[g] : hi_of[g]]
            if from_before[g] or to_after[g]:
                targets = into[root[into[:, 0] - a] == root[idx[0] - a], 1]
                opens.append({"i": idx, "heads": t[heads[root[heads - a] == root[idx[0] - a]]].tolist(), "into": np.unique(t[targets]).tolist()})
                spans.append((int(sess[idx[0]]), -math.inf if from_before[g] else int(t[idx[0]]), math.inf if to_after[g] else int(t[idx[-1]])))
                continue
            for p in [idx] if _fits(la[idx], lo[idx], radius_m) else [idx[q] for q in _by_place(la[idx], lo[idx], radius_m, max_elsewhere)]:
                if t[p[-1]] - t[p[0]] >= min_us:
                    units.append({"t0": int(t[p[0]]), "t1": int(t[p[-1]]), "n": len(p), "at": t[p], "odds": _evidence(la[p], lo[p]), "i": p, "out": int(p[-1] - p[0] + 1 - len(p)), "s": int(sess[p[0]])})
        free, tied = units, []
        while True:  # what overlaps an open component, or a dwell that does, is decided outside the block
            hit = [any(s == u["s"] and b <= u["t1"] and e >= u["t0"] for s, b, e in spans) for u in free]
            if not any(hit):
                break
            new = [u for u, h in zip(free, hit) if h]
            free, tied, spans = [u for u, h in zip(free, hit) if not h], tied + new, [(u["s"], u["t0"], u["t1"]) for u in new]
        return k, t, la, lo, cum, brk, a, z, free, [*opens, *tied]

    def work(block: pd.DataFrame, number: int) -> pd.DataFrame:
        k, t, la, lo, cum, brk, a, z, free, pieces = parts(block, number)
        n = len(k)

        def event(kind, i, j, pings=0, **more):
            return {"k": k[i], "kind": kind, "t0": int(t[i]), "t1": int(t[j]), "c0": float(cum[i]), "c1": float(cum[j]), "n": pings} | more

        out = [event(_START, i, i) for i in np.flatnonzero(brk[a:z]) + a]
        last = np.zeros(n, bool)
        last[:-1] = brk[1:]
        last[-1] = z == n  # nothing follows the last ping of all
        out += [event(_END, i, i) for i in np.flatnonzero(last[a:z]) + a]

        for m, u in enumerate(pieces):
            idx = u["i"]
            far = idx[_hull(*_flat(la[idx], lo[idx], la[idx[0]], lo[idx[0]]))]
            out.append(event(_OPEN, idx[0], idx[-1], len(idx), block=number, unit=m, into=u.get("into", []), heads=u.get("heads", []), hla=la[far].tolist(), hlo=lo[far].tolist()))
        for us in [[u for u in free if u["s"] == s] for s in dict.fromkeys(u["s"] for u in free)]:
            for c in _decoded(us, min_us, durations):
                i, j = np.searchsorted(t[c["i"]], (c["t0"], c["t1"]))
                out.append(event(_STOP, c["i"][i], c["i"][j], c["n"]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _EVENT.split(", ")])
        for c in ("block", "unit"):
            frame[c] = frame[c].astype("Int64")
        for c in ("into", "heads", "hla", "hlo"):
            frame[c] = pd.Series([h if isinstance(h, list) else None for h in frame[c]], dtype=object)
        return frame

    events = reliable(blocks.map(work, _EVENT))
    pieces = events.where(F.col("kind") == _OPEN).orderBy("block", "unit").toPandas()  # 2 reach a block, and the dwells among their pings
    joined, knots = _join_pieces(pieces, radius_m, min_us)
    spark = df.sparkSession
    plain = ["k", "kind", "t0", "t1", "c0", "c1"]
    marks = events.where(F.col("kind") != _OPEN).select(plain)
    if joined:
        marks = marks.unionByName(spark.createDataFrame([[u[c] for c in plain] for u in joined], "k string, kind int, t0 long, t1 long, c0 double, c1 double"))
    if knots:

        def gather(block: pd.DataFrame, number: int) -> pd.DataFrame:
            if number not in knots:
                return pd.DataFrame(columns=[c.split()[0] for c in _KNOT.split(", ")], dtype=object)  # empty columns of floats are no text to Arrow
            k, t, la, lo, cum, _, a, _, _, pieces = parts(block, number)
            units, places = zip(*knots[number].items())
            i = np.concatenate([pieces[u]["i"] for u in units])
            g, m = np.repeat(np.array(places), [len(pieces[u]["i"]) for u in units], axis=0).T
            return pd.DataFrame({"k": k[i], "g": g, "m": m, "t": t[i], "lat": la[i], "lon": lo[i], "c": cum[i], "at": offset[number] + i - a})

        def untie(g: pd.DataFrame) -> pd.DataFrame:
            units = []
            for _, x in g.sort_values("t").groupby("m"):
                t, la, lo, c, at = (x[n].to_numpy() for n in ("t", "lat", "lon", "c", "at"))
                for p in _by_place(la, lo, radius_m, max_elsewhere):
                    if t[p[-1]] - t[p[0]] >= min_us:
                        units.append({"t0": int(t[p[0]]), "t1": int(t[p[-1]]), "n": len(p), "at": t[p], "odds": _evidence(la[p], lo[p]), "c": c[p], "out": int(at[p[-1]] - at[p[0]] + 1 - len(p))})
            out = [(g["k"].iloc[0], _STOP, u["t0"], u["t1"], *u["c"][np.searchsorted(u["all"], (u["t0"], u["t1"]))]) for u in _decoded([u | {"all": u["at"]} for u in units], min_us, durations)]
            return pd.DataFrame(out, columns=plain)

        untied = blocks.map(gather, _KNOT).groupBy("g").applyInPandas(untie, "k string, kind int, t0 long, t1 long, c0 double, c1 double")
        marks = marks.unionByName(untied)
    lines = OrderedBlocks(marks, ["k", "t0", "kind", "t1"], [], rows_per_block=rows_per_block)
    ends = lines.reports(lambda m: m[["k", "t1", "c1"]].iloc[-1:].copy(), "k string, t1 long, c1 double")
    ahead = dict(zip(ends[BLOCK].tolist()[1:], ends[["k", "t1", "c1"]].itertuples(index=False)))

    def legs(m: pd.DataFrame, number: int) -> pd.DataFrame:
        """Stops, and a trip wherever time passes from one mark of a key to the next."""
        e = ahead.get(number, (None, 0, 0.0))
        k, kind, t0, t1, c0, c1 = (m[c].to_numpy() for c in plain)
        k0, p1, pc = np.r_[np.array([e[0]], object), k[:-1]], np.r_[[int(e[1])], t1[:-1]], np.r_[[float(e[2])], c1[:-1]]
        trip, stop = (k == k0) & (kind != _START) & (p1 < t0), kind == _STOP
        a, b = np.r_[p1[trip], t0[stop]], np.r_[t0[trip], t1[stop]]
        return pd.DataFrame({
            "traj_id": np.r_[k[trip], k[stop]], "kind": np.repeat(np.array(["trip", "stop"], object), [trip.sum(), stop.sum()]), "start_at": text_time(a), "end_at": text_time(b),
            "duration_s": (b - a) / 1e6, "distance_m": np.maximum(np.r_[c0[trip] - pc[trip], c1[stop] - c0[stop]], 0.0),
        })

    return lines.map(legs, "traj_id string, kind string, start_at string, end_at string, duration_s double, distance_m double")


def _join_pieces(pieces: pd.DataFrame, radius_m: float, min_us: int) -> tuple[list[dict], dict[int, dict[int, tuple[int, int]]]]:
    """Joins components across blocks. Returns the stops that are plain already, and for the rest ``{block: {unit:
    (stretch, component)}}``: the pieces whose pings have to come together."""
    p = pieces.to_dict("records")
    parent: dict[int, int] = {}
    by_head = {(u["k"], int(h)): i for i, u in enumerate(p) for h in u["heads"]}
    for i, u in enumerate(p):
        for t in u["into"]:
            a, b = _find(parent, i), _find(parent, by_head[u["k"], int(t)])
            if a != b:
                parent[b] = a
    members: dict[int, list[dict]] = {}
    for i, u in enumerate(p):
        members.setdefault(_find(parent, i), []).append(u)
    whole: dict[str, list[dict]] = {}
    for us in members.values():
        early, late = min(us, key=lambda u: u["t0"]), max(us, key=lambda u: u["t1"])
        if late["t1"] - early["t0"] >= min_us:
            whole.setdefault(early["k"], []).append({"k": early["k"], "t0": early["t0"], "c0": early["c0"], "t1": late["t1"], "c1": late["c1"], "of": us})
    stops, knots, stretch, component = [], {}, 0, 0
    for us in whole.values():
        for some in _stretches(us):
            if len(some) == 1 and _fits(*(np.concatenate([np.asarray(u[c], float) for u in some[0]["of"]]) for c in ("hla", "hlo")), radius_m):
                stops.append(some[0] | {"kind": _STOP})
                continue
            for m in some:
                for u in m["of"]:
                    knots.setdefault(int(u["block"]), {})[int(u["unit"])] = (stretch, component)
                component += 1
            stretch += 1
    return stops, knots
