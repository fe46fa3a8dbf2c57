"""Points near other points, and the regions that contain them.

A bounded sample of the points drives a quadtree whose cells hold about equal numbers of points. Points go to
the cell they lie in, and as replicas to every cell that their search circle touches. In each cell a bulk-loaded
R-tree is probed with all boxes at once, then candidates are checked exactly (haversine, or straight edges in
lon/lat). A pair is reported only by the cell of its reference point, which is the position of the smaller id
(for regions: of the point), so no pair comes out twice and nothing needs a distinct.

Skew: a town too dense for one cell that can't be split further gets several shares; its points are spread over
the shares, and each pair of shares is a task of its own, so no task holds the whole town. A person who fills shares
gets shares of their own, and no two of these are paired, so a place with one person's points only copies each point
once. A person with very many points in one task gets an own tree there, so pairs within one person are not even
candidates. Of a region, a cell gets only the edges that decide about its points: those at its height and not west of it.

Defined results: points with a missing coordinate, ``lat`` outside -90..90 or ``lon`` outside -180..360 take no
part; ``lon`` from 180 is ``lon - 360``; points without id or person take no part in pairs. Empty tables give
no rows. A ring of fewer than three vertices has no inside; a region without an outer ring holds nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.npgeo import EARTH_KM, haversine_m
from pathloom.functions.spindex import Quadtree, RTree

SAMPLE_POINTS = 100_000  # bound of the sample that reaches the driver
CELL_POINTS = 20_000
HEAVY = 2_000  # points of one person in one task from which they get an own tree


def clean_points(df: DataFrame, point_id: str, lat: str = "lat", lon: str = "lon", person: str | None = None, known: bool = True) -> DataFrame:
    """``pid, y, x`` and, with ``person``, ``who`` of the points that take part; ``known``: only of known persons."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    ok = ~F.isnan(la) & ~F.isnan(lo) & la.between(-90, 90) & lo.between(-180, 360) & F.col(point_id).isNotNull()
    cols = [F.col(point_id).cast("long").alias("pid"), la.alias("y"), F.when(lo >= 180, lo - 360).otherwise(lo).alias("x")]
    if person:
        ok = ok & F.col(person).isNotNull() if known else ok
        cols.append(F.col(person).cast("string").alias("who"))
    return df.where(ok).select(*cols)


def quadtree_of(points: DataFrame, least_deg: float, sample: int = SAMPLE_POINTS, capacity: int = CELL_POINTS) -> Quadtree:
    """The cells for cleaned points, from a hash sample of about ``sample`` of them, whatever their number."""
    n = points.count()
    turn = 1 << 52
    keep = turn if n <= sample else max(int(sample / n * turn), 1)
    cols = [c for c in ("x", "y", "who") if c in points.columns]
    picked = points.where(F.pmod(F.xxhash64("pid"), F.lit(turn)) < keep).select(*cols).toPandas() if n else pd.DataFrame({c: [] for c in cols})
    who = picked["who"].fillna("") if "who" in cols else None
    return Quadtree(picked["x"].to_numpy(), picked["y"].to_numpy(), n / max(len(picked), 1), capacity, least_deg, who=who)


def _reach(y: np.ndarray, metres: float) -> tuple[float, np.ndarray]:
    """Half height and half width in degrees of a circle's box; 360 where it holds a pole."""
    r = metres / (EARTH_KM * 1000) * (1 + 1e-9) + 1e-15
    dy = np.degrees(r)
    c = np.cos(np.radians(y))
    polar = np.abs(y) + dy >= 90
    return dy, np.where(polar, 360.0, np.degrees(np.arcsin(np.minimum(np.sin(r) / np.maximum(c, 1e-12), 1.0))) * (1 + 1e-9))


def _box(x, y, metres):
    dy, dx = _reach(y, metres)
    whole = dx >= 180
    return np.where(whole, -180.0, x - dx), y - dy, np.where(whole, 180.0, x + dx), y + dy


def _copies(x0, x1) -> list[tuple[np.ndarray, float]]:
    """Which boxes also lie on the map shifted by a full turn."""
    whole = x1 - x0 >= 360
    return [(np.arange(len(x0)), 0.0), (np.flatnonzero((x0 < -180) & ~whole | (x0 == -180) & (x1 == -180)), 360.0), (np.flatnonzero((x1 >= 180) & ~whole), -360.0)]


_TAGGED = "cell int, i int, j int, blk int, home boolean, pid long, who string, y double, x double"


def pairs_within(points: DataFrame, tree: Quadtree, metres: float) -> DataFrame:
    """``a_id, b_id, metres`` of points of different persons at most ``metres`` apart, the smaller id first.

    ``points``: from ``clean_points`` with a person; ids are unique.
    """
    shares, mixed, pure = tree.shares, tree.mixed, tree.pure

    def tag(batches):
        for d in batches:
            who = d["who"].to_numpy()
            x, y, pid = d["x"].to_numpy(), d["y"].to_numpy(), d["pid"].to_numpy()
            x0, y0, x1, y1 = _box(x, y, metres)
            home = tree.home(x, y)
            at, cell, moved = [], [], []
            for idx, shift in _copies(x0, x1):
                q, c = tree.overlaps(x0[idx] + shift, y0[idx], x1[idx] + shift, y1[idx])
                at.append(idx[q])
                cell.append(c)
                moved.append(np.full(len(q), shift))
            at, cell, moved = np.concatenate(at), np.concatenate(cell), np.concatenate(moved)
            mix = (pid[at].astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("int64")
            first, own = np.zeros(len(at), "int64"), np.zeros(len(at), "int64")  # the person's own shares
            for q in np.flatnonzero(shares[cell] > mixed[cell]):
                first[q], own[q] = pure.get((int(cell[q]), str(who[at[q]])), (0, 0))
            blk = np.where(own > 0, first + mix % np.maximum(own, 1), mix % mixed[cell])
            b = shares[cell] - own  # a task with each share but the person's own ones
            rep = np.repeat(np.arange(len(at)), b)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(b) - b, b)
            other = other + np.where((own[rep] > 0) & (other >= first[rep]), own[rep], 0)
            src = at[rep]
            yield pd.DataFrame({
                "cell": cell[rep].astype("int32"), "i": np.minimum(blk[rep], other).astype("int32"), "j": np.maximum(blk[rep], other).astype("int32"), "blk": blk[rep].astype("int32"),
                "home": (home[src] == cell[rep]) & (moved[rep] == 0), "pid": pid[src], "who": who[src], "y": y[src], "x": x[src] + moved[rep],
            })

    def join(g: pd.DataFrame) -> pd.DataFrame:
        pid, x, y, home, blk = (g[c].to_numpy() for c in ("pid", "x", "y", "home", "blk"))
        who, n_of = np.unique(g["who"].to_numpy(str), return_inverse=True)[1], None
        n_of = np.bincount(who)
        cross = g["i"].iloc[0] != g["j"].iloc[0]
        heavy = n_of[who] > HEAVY
        builds = [np.flatnonzero(~heavy), *(np.flatnonzero(who == h) for h in np.flatnonzero(n_of > HEAVY))]
        found_a, found_b, found_d = [], [], []
        for side in np.unique(blk) if cross else [None]:
            for no, build in enumerate(builds):
                probe = np.flatnonzero(home)
                if side is not None:
                    build, probe = build[blk[build] == side], probe[blk[probe] != side]
                if no and len(build):  # a heavy person's tree is never probed with that person
                    probe = probe[who[probe] != who[build[0]]]
                if not len(build) or not len(probe):
                    continue
                x0, y0, x1, y1 = _box(x[probe], y[probe], metres)
                index = RTree(x[build], y[build], x[build], y[build])
                for q, e in index.probe(x0, y0, x1, y1):
                    a, b = probe[q], build[e]
                    keep = (pid[a] < pid[b]) & (who[a] != who[b])
                    a, b = a[keep], b[keep]
                    d = haversine_m(y[a], x[a], y[b], x[b])
                    ok = d <= metres
                    found_a.append(pid[a[ok]])
                    found_b.append(pid[b[ok]])
                    found_d.append(d[ok])
        empty = np.empty(0)
        out = pd.DataFrame({"a_id": np.concatenate([empty.astype("int64"), *found_a]), "b_id": np.concatenate([empty.astype("int64"), *found_b]), "metres": np.concatenate([empty, *found_d])})
        return out.drop_duplicates(["a_id", "b_id"]) if (np.abs(x) > 179.9).any() else out  # one place on both edges of the map

    return points.mapInPandas(tag, _TAGGED).groupBy("cell", "i", "j").applyInPandas(join, "a_id long, b_id long, metres double")


def _unwrap(x: np.ndarray) -> np.ndarray:
    """Longitudes along a ring without jumps: each edge goes the short way round."""
    step = np.diff(x)
    return np.r_[x[:1], x[:1] + np.cumsum((step + 180) % 360 - 180)]


def _crossings(px, py, ax, ay, bx, by) -> np.ndarray:
    """Whether an odd number of edges lies east of each point at its height (half-open edges)."""
    inside = np.zeros(len(px), bool)
    step = max(1, 2_000_000 // max(len(ax), 1))
    for s in range(0, len(px), step):
        part = slice(s, s + step)
        x, y = px[part, None], py[part, None]
        spans = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        inside[part] = hit.sum(1) % 2 == 1
    return inside


def regions_of(vertices: DataFrame, region: str = "region_id", ring: str = "ring", order: str = "vertex_no", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per region: ``rid`` and its rings (0 outer, others holes) as ordered vertices."""
    ok = F.col(region).isNotNull() & F.col(ring).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
    v = vertices.where(ok).select(F.col(region).cast("long").alias("rid"), F.col(ring).cast("int").alias("ring"), F.struct(F.col(order).alias("o"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).alias("v"))
    rings = v.groupBy("rid", "ring").agg(F.array_sort(F.collect_set("v")).alias("v"))
    return rings.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("ring", F.col("v.y").alias("ys"), F.col("v.x").alias("xs")))).alias("rings"))


def points_in_regions(points: DataFrame, regions: DataFrame, tree: Quadtree) -> DataFrame:
    """``region_id, point_id`` of points in an outer ring and in no hole. ``regions``: from ``regions_of``."""
    shares = tree.shares

    def tag_points(batches):
        for d in batches:
            x, y, pid = d["x"].to_numpy(), d["y"].to_numpy(), d["pid"].to_numpy()
            cell = tree.home(x, y)
            yield pd.DataFrame({"cell": cell.astype("int32"), "blk": (np.arange(len(d)) % shares[cell]).astype("int32"), "pid": pid, "y": y, "x": x})

    cx0, cy0, _, cy1 = tree.boxes()

    def tag_regions(batches):
        for d in batches:
            out = []
            for rid, rings in zip(d["rid"], d["rings"]):
                shape = [(r["ring"], _unwrap(np.asarray(r["xs"], float)), np.asarray(r["ys"], float)) for r in rings if len(r["xs"]) >= 3]
                if not shape or shape[0][0] != 0:
                    continue
                middle = shape[0][1].mean()
                shape = [(n, x + 360 * np.round((middle - x.mean()) / 360), y) for n, x, y in shape]
                x0, x1, y0, y1 = shape[0][1].min(), shape[0][1].max(), shape[0][2].min(), shape[0][2].max()
                ring = np.repeat(np.arange(len(shape)), [len(x) for _, x, _ in shape])
                ay, by = np.concatenate([y for _, _, y in shape]), np.concatenate([np.roll(y, -1) for _, _, y in shape])
                for turn in range(-2, 3):
                    s = 360.0 * turn
                    if x1 + s < -180 or x0 + s > 180:
                        continue
                    ax, bx = np.concatenate([x for _, x, _ in shape]) + s, np.concatenate([np.roll(x, -1) for _, x, _ in shape]) + s
                    _, cells = tree.overlaps(np.array([x0 + s]), np.array([y0]), np.array([x1 + s]), np.array([y1]))
                    for c in np.unique(cells):
                        e = (np.maximum(ay, by) >= cy0[c]) & (np.minimum(ay, by) <= cy1[c]) & (np.maximum(ax, bx) >= cx0[c])
                        if not (e & (ring == 0)).any():
                            continue
                        own = (ring[e], ax[e], ay[e], bx[e], by[e])
                        for b in range(shares[c]):
                            out.append((c, b, rid, x0 + s, y0, x1 + s, y1, *own))
            yield pd.DataFrame(out, columns=["cell", "blk", "rid", "x0", "y0", "x1", "y1", "ring", "ax", "ay", "bx", "by"])

    def join(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        rid, pid = [], []
        if len(p) and len(r):
            px, py, ids = p["x"].to_numpy(), p["y"].to_numpy(), p["pid"].to_numpy()
            index = RTree(*(r[c].to_numpy() for c in ("x0", "y0", "x1", "y1")))
            for q, e in index.probe(px, py, px, py):
                order = np.argsort(e, kind="stable")
                q, e = q[order], e[order]
                for g in np.split(np.arange(len(e)), np.flatnonzero(np.diff(e)) + 1):
                    k, at = e[g[0]], q[g]
                    ring, *edges = (np.asarray(r[c].iloc[k]) for c in ("ring", "ax", "ay", "bx", "by"))
                    ok = _crossings(px[at], py[at], *(v[ring == 0] for v in edges))
                    for hole in np.unique(ring[ring > 0]):
                        ok &= ~_crossings(px[at], py[at], *(v[ring == hole] for v in edges))
                    pid.append(ids[at[ok]])
                    rid.append(np.full(int(ok.sum()), r["rid"].iloc[k]))
        none = np.empty(0, "int64")
        out = pd.DataFrame({"region_id": np.concatenate([none, *rid]), "point_id": np.concatenate([none, *pid])})
        return out.drop_duplicates()

    left = points.mapInPandas(tag_points, "cell int, blk int, pid long, y double, x double").groupBy("cell", "blk")
    right = regions.mapInPandas(tag_regions, "cell int, blk int, rid long, x0 double, y0 double, x1 double, y1 double, ring array<int>, ax array<double>, ay array<double>, bx array<double>, by array<double>").groupBy("cell", "blk")
    return left.cogroup(right).applyInPandas(join, "region_id long, point_id long")


def near_and_inside(points: DataFrame, vertices: DataFrame, metres: float = 30.0, point_id: str = "point_id", person: str = "id", sample: int = SAMPLE_POINTS, capacity: int = CELL_POINTS) -> DataFrame:
    """``relation, a_id, b_id``: ``near`` (two points of different persons) and ``inside`` (region, point)."""
    everyone = clean_points(points, point_id)
    tree = quadtree_of(clean_points(points, point_id, person=person, known=False), 8 * np.degrees(metres / (EARTH_KM * 1000)), sample, capacity)
    near = pairs_within(clean_points(points, point_id, person=person), tree, metres)
    inside = points_in_regions(everyone, regions_of(vertices), tree)
    return near.select(F.lit("near").alias("relation"), "a_id", "b_id").unionByName(inside.select(F.lit("inside").alias("relation"), F.col("region_id").alias("a_id"), F.col("point_id").alias("b_id")))
