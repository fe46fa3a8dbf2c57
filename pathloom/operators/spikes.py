"""Implausible readings: spikes, stuck values and impossible values, judged per source and field.

* Spikes: a Hampel filter proposes, an exact check decides. Of each reading, median and median absolute deviation (MAD)
  come from the ``flank`` readings on either side of it, of the same source and field. A reading is far if it is more
  than ``sigmas`` scaled MADs (at least usual changes), or half of ``threshold`` usual changes, from its median,
  whichever is less. A stretch of one to ``max_spike`` readings is a candidate if each of its readings is far, or its two neighbours are far from that
  reading's median (as at a change of level). The usual change is the source's median absolute difference of successive
  readings (exact). A candidate is a spike if its readings differ by more than ``threshold`` usual changes from both
  neighbours, and these do not differ so from each other. No spike is missed: a reading within half the limit of its
  median whose neighbour is so as well is within the limit of that neighbour.
* Stuck values: runs of ``min_run`` or more equal readings, unless the source stands throughout.
* Physical bounds per field.

The table lies in even blocks by (source, time); ``flank + max_spike + 1`` readings per side and field and the runs at a
block's edges travel between blocks, so a source of any size is spread over many tasks. Only for sources that span
blocks the usual change takes a job of its own, an exact quantile from even blocks of sorted differences.

Defined results: rows equal in all but the row id count once (the smallest id); null and NaN are no readings;
rows without a source are not judged; rows without a time come before all others of their source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.times import micros
from pathloom.operators.blocks import BLOCK, ROWS_PER_BLOCK, OrderedBlocks, halos, reliable
from pathloom.operators.quantiles import grouped_quantiles

_RUN = ("k", "v", "n", "zero", "m0", "m1")  # a run of equal readings: is `still` 0 throughout, range of `place`
_REPORT = "f string, k string, v double, _side string, n long, zero boolean, m0 double, m1 double, whole boolean"


class _Field:
    """The readings of one field in a block, as arrays."""

    def __init__(self, block: pd.DataFrame, name: str, still: str, place: str):
        v = block[f"v_{name}"].to_numpy("float64", na_value=np.nan)
        at = np.flatnonzero(~np.isnan(v))
        self.at, self.v, self.k = at, v[at], block["k"].to_numpy()[at]
        s = block[f"v_{still}"].to_numpy("float64", na_value=np.nan)[at]
        p = block[f"v_{place}"].to_numpy("float64", na_value=np.nan)[at]
        n = len(at)
        change = np.ones(n, bool)
        change[1:] = (self.k[1:] != self.k[:-1]) | (self.v[1:] != self.v[:-1])
        self.run = np.cumsum(change) - 1
        self.first = np.flatnonzero(change)
        self.n = np.diff(np.r_[self.first, n])
        if n:
            self.zero = np.logical_and.reduceat((s == 0) | np.isnan(s), self.first) & np.logical_or.reduceat(s == 0, self.first)
            self.m0 = np.fmin.reduceat(p, self.first)
            self.m1 = np.fmax.reduceat(p, self.first)
        else:
            self.zero, self.m0, self.m1 = np.zeros(0, bool), np.zeros(0), np.zeros(0)

    def edge(self, i: int) -> dict:
        return {"k": self.k[self.first[i]], "v": float(self.v[self.first[i]]), "n": int(self.n[i]), "zero": bool(self.zero[i]), "m0": float(self.m0[i]), "m1": float(self.m1[i])}


def _merge(a: dict, b: dict) -> dict:
    return a | {"n": a["n"] + b["n"], "zero": a["zero"] and b["zero"], "m0": np.fmin(a["m0"], b["m0"]), "m1": np.fmax(a["m1"], b["m1"])}


def _same(a: dict | None, b: dict | None) -> bool:
    return a is not None and b is not None and a["k"] == b["k"] and a["v"] == b["v"]


def rolling(k: np.ndarray, v: np.ndarray, flank: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of the ``flank`` readings on either side of each reading (itself left out), of the same source;
    NaN where there are none."""
    n = len(v)
    around = np.full((n, 2 * flank), np.nan)
    for c, d in enumerate([*range(-flank, 0), *range(1, flank + 1)]):
        i = np.arange(max(0, -d), min(n, n - d))
        same = k[i] == k[i + d]
        around[i[same], c] = v[i[same] + d]
    count = (~np.isnan(around)).sum(1)
    lo, hi, row = np.maximum(count - 1, 0) // 2, count // 2, np.arange(n)

    def middle(x: np.ndarray) -> np.ndarray:
        x = np.sort(x, axis=1)
        return np.where(count > 0, (x[row, lo] + x[row, np.minimum(hi, 2 * flank - 1)]) / 2, np.nan)

    median = middle(around)
    return median, middle(np.abs(around - median[:, None]))


def spikes(k: np.ndarray, v: np.ndarray, usual: np.ndarray, threshold: float, max_spike: int, flank: int, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates, spikes among them, rolling median and MAD of each reading (in order of source and time)."""
    med, mad = rolling(k, v, flank)
    limit = usual * threshold
    # half the limit at most, so that no spike is missed; a hair less for rounding
    far_at = np.minimum(limit / 2, sigmas * 1.4826 * np.maximum(mad, usual)) * (1 - 1e-9) - 1e-12
    far = np.abs(v - med) > far_at
    candidate, found = np.zeros(len(v), bool), np.zeros(len(v), bool)
    for width in range(1, max_spike + 1):
        i = np.arange(1, len(v) - width)  # first reading of the tested stretch
        i = i[k[i - 1] == k[i + width]]
        p, q = v[i - 1], v[i + width]
        ok = np.ones(len(i), bool)
        for j in range(width):
            m = i + j
            ok &= far[m] | ((np.abs(p - med[m]) > far_at[m]) & (np.abs(q - med[m]) > far_at[m]))
        i, p, q, lim = i[ok], p[ok], q[ok], limit[i[ok]]
        spike = np.abs(p - q) <= lim  # the exact check
        for j in range(width):
            candidate[i + j] = True
            spike &= (np.abs(v[i + j] - p) > lim) & (np.abs(v[i + j] - q) > lim)
        for j in range(width):
            found[i[spike] + j] = True
    return candidate, found, med, mad


def implausible(
    df: DataFrame,
    bounds: dict[str, tuple[float, float]],
    key: str = "traj_id",
    time: str = "DateTime",
    row_id: str = "row_id",
    still: str = "Speed",
    place: str = "lat",
    threshold: float = 15.0,
    max_spike: int = 3,
    flank: int = 7,
    sigmas: float = 3.0,
    min_run: int = 8,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``row_id, traj_id, field, value, rule (bounds|stuck|spike), rolling_median, rolling_mad, usual_change``.

    One row per flagged reading and field; of several rules the first in the order named is given.
    """
    fields = list(bounds)
    used = list(dict.fromkeys([*fields, still, place]))
    # what makes rows equal: every column but the row id, whatever its name; maps have no order and compare as text
    same = {f"g{i}": F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for i, f in enumerate(df.schema) if f.name != row_id}
    name_of = {f.name: f"g{i}" for i, f in enumerate(df.schema) if f.name != row_id}
    one = df.where(F.col(key).isNotNull()).select(F.col(row_id).alias("r"), *(v.alias(n) for n, v in same.items())).groupBy(*same).agg(F.min("r").alias("r"))
    rows = one.select(F.col(name_of[key]).cast("string").alias("k"), micros(name_of[time]).alias("t"), "r", F.col("r").cast("string").alias("id"), *(F.col(name_of[c]).cast("double").alias(f"v_{c}") for c in used))
    blocks = OrderedBlocks(rows, ["k", "t", "r"], [], keep=["k", "id", *(f"v_{c}" for c in used)], rows_per_block=rows_per_block)
    h = max_spike + flank + 1

    def report(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f in fields:
            x = _Field(block, f, still, place)
            if not len(x.v):
                continue
            nothing = {"n": None, "zero": None, "m0": None, "m1": None}
            whole = len(x.first) == 1
            for side, sl in (("a", slice(0, h)), ("z", slice(-h, None))):
                out += [{"f": f, "k": k, "v": v, "_side": side, "whole": whole} | nothing for k, v in zip(x.k[sl], x.v[sl])]
            out += [{"f": f, "_side": "A", "whole": whole} | x.edge(0), {"f": f, "_side": "Z", "whole": whole} | x.edge(len(x.first) - 1)]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _REPORT.split(", ")])
        frame["n"] = frame["n"].astype("Int64")
        return frame

    reports = blocks.reports(report, _REPORT)
    near, before, after, spanning = {}, {}, {}, set()
    for f, g in reports.groupby("f"):
        rest = g[g["_side"].isin(["a", "z"])]
        near[f] = halos(rest[[BLOCK, "k", "v", "_side"]], h)
        heads = {int(r[BLOCK]): r for r in g[g["_side"] == "A"].to_dict("records")}
        tails = {int(r[BLOCK]): r for r in g[g["_side"] == "Z"].to_dict("records")}
        ids = sorted(heads)
        run = None
        for b in ids:  # the run that reaches each block's start
            if _same(run, heads[b]):
                before[f, b] = run
            run = _merge(run, heads[b]) if heads[b]["whole"] and (f, b) in before else tails[b]
        run = None
        for b in reversed(ids):
            if _same(run, tails[b]):
                after[f, b] = run
            run = _merge(run, heads[b]) if heads[b]["whole"] and (f, b) in after else heads[b]
        for a, b in zip(ids, ids[1:]):
            if tails[a]["k"] == heads[b]["k"]:
                spanning.add(tails[a]["k"])

    def differences(x: _Field, f: str, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Absolute change of each reading from the one before it, of the same source."""
        lead = near[f][b][0]
        k = np.r_[lead["k"].to_numpy(object)[-1:], x.k]
        v = np.r_[lead["v"].to_numpy("float64")[-1:], x.v]
        same = k[1:] == k[:-1]
        return k[1:][same], np.abs(np.diff(v))[same]

    usual: dict[tuple[str, str], float] = {}
    if spanning:

        def changes(block: pd.DataFrame, b: int) -> pd.DataFrame:
            out = [pd.DataFrame({"g": pd.Series(dtype=object), "d": pd.Series(dtype=float)})]
            for f in fields:
                x = _Field(block, f, still, place)
                if len(x.v):
                    k, d = differences(x, f, b)
                    wide = np.isin(k, list(spanning))
                    out.append(pd.DataFrame({"g": [f"{f}|{name}" for name in k[wide]], "d": d[wide]}))
            return pd.concat(out, ignore_index=True)

        medians = grouped_quantiles(reliable(blocks.map(changes, "g string, d double")), "g", "d", [0.5])
        for r in medians.collect():  # one per block and field at most
            f, _, k = r["g"].partition("|")
            usual[k, f] = r["q"][0]

    def work(block: pd.DataFrame, b: int) -> pd.DataFrame:
        out = []
        ids = block["id"].to_numpy()
        for f in fields:
            x = _Field(block, f, still, place)
            n = len(x.v)
            if not n:
                continue
            dk, dd = differences(x, f, b)
            med = pd.Series(dd).groupby(dk).median() if len(dd) else pd.Series(dtype=float)
            by_key = {k: usual.get((k, f), med.get(k, np.nan)) for k in pd.unique(x.k)}
            u = np.array([by_key[k] for k in x.k])
            low, high = bounds[f]
            out_of = (x.v < low) | (x.v > high)

            length, zero, m0, m1 = x.n.copy(), x.zero.copy(), x.m0.copy(), x.m1.copy()
            for i, other in ((0, before.get((f, b))), (-1, after.get((f, b)))):
                if other is not None:
                    length[i] += other["n"]
                    zero[i] &= other["zero"]
                    m0[i], m1[i] = np.fmin(m0[i], other["m0"]), np.fmax(m1[i], other["m1"])
            stuck = ((length >= min_run) & ~(zero & ~(m0 != m1)))[x.run]

            lead, trail = near[f][b]
            k = np.r_[lead["k"].to_numpy(object), x.k, trail["k"].to_numpy(object)]
            v = np.r_[lead["v"].to_numpy("float64"), x.v, trail["v"].to_numpy("float64")]
            a, z = len(lead), len(lead) + n
            # of neighbouring blocks only readings of a source that this block shares take part
            own = np.r_[np.full(a, u[0]), u, np.full(len(trail), u[-1])]
            _, spike, rmed, rmad = (y[a:z] for y in spikes(k, v, own, threshold, max_spike, flank, sigmas))
            bad = np.flatnonzero(out_of | stuck | spike)
            rule = np.where(out_of[bad], "bounds", np.where(stuck[bad], "stuck", "spike"))
            out.append(pd.DataFrame({"row_id": ids[x.at[bad]], "traj_id": x.k[bad], "field": f, "value": x.v[bad], "rule": rule, "rolling_median": rmed[bad], "rolling_mad": rmad[bad], "usual_change": u[bad]}))
        if not out:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return pd.concat(out, ignore_index=True)

    schema = "row_id string, traj_id string, field string, value double, rule string, rolling_median double, rolling_mad double, usual_change double"
    found = blocks.map(work, schema)
    found = found.withColumn("row_id", F.col("row_id").cast(df.schema[row_id].dataType))
    return found.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c.startswith(("rolling", "usual")) else F.col(c) for c in found.columns))
