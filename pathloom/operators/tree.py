"""Per-key results without imbalance: multi-level tree aggregation.

Counts, first and last time need no order. Input chunks (the scan's splits, whose size is fixed) are combined where they
are read; the states, one per key and chunk, are merged in rounds of ``fan_in`` chunks each, so the number of rounds is
logarithmic in the number of chunks, no reducer ever gets more than ``fan_in`` states of a key, and no row is shuffled.

Path lengths need the order of time. Only where they are asked for, the table is range-partitioned on (key, time, row
id), so chunks are even although a few keys hold most rows. Within a partition every Arrow batch is combined into one
state per key and appended to the open state of its key. Only a partition's first and last key can go on in another
partition; their states (two per partition at most) are merged in the same rounds of ``fan_in`` neighbours. The state
keeps first and last point, so path lengths merge as well as sums do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.npgeo import haversine_m
from pathloom.functions.times import micros
from pathloom.operators.blocks import ROWS_PER_BLOCK, reliable, shuffle_partitions

_STATE = "n long, points long, t0 long, t1 long, la0 double, lo0 double, la1 double, lo1 double, path double"
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]


def _append(a: dict, b: dict) -> dict:
    """The state of two stretches of one key, ``a`` before ``b``."""
    if not a["points"]:
        return b | {"n": a["n"] + b["n"]}
    if not b["points"]:
        return a | {"n": a["n"] + b["n"]}
    step = float(haversine_m(a["la1"], a["lo1"], b["la0"], b["lo0"]))
    return a | {"n": a["n"] + b["n"], "points": a["points"] + b["points"], "t1": b["t1"], "la1": b["la1"], "lo1": b["lo1"], "path": a["path"] + step + b["path"]}


def _states(chunk: pd.DataFrame) -> list[dict]:
    """One state per key of a chunk that is sorted by key and time."""
    k = chunk["k"].to_numpy(object)
    n = len(k)
    null = pd.isna(k)
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) & ~(null[1:] & null[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    t, la, lo = chunk["t"].to_numpy("float64", na_value=np.nan), chunk["lat"].to_numpy("float64", na_value=np.nan), chunk["lon"].to_numpy("float64", na_value=np.nan)
    t_int = chunk["t"].fillna(0).to_numpy("int64")
    at = np.flatnonzero(~(np.isnan(t) | np.isnan(la) | np.isnan(lo)))
    g = group[at]
    rows = np.bincount(group, minlength=len(first))
    points = np.bincount(g, minlength=len(first))
    path = np.zeros(len(first))
    if len(at) > 1:
        step = haversine_m(la[at[:-1]], lo[at[:-1]], la[at[1:]], lo[at[1:]])
        same = g[1:] == g[:-1]
        path = np.bincount(g[1:][same], weights=step[same], minlength=len(first))
    lo_at, hi_at = np.searchsorted(g, np.arange(len(first))), np.searchsorted(g, np.arange(len(first)), side="right") - 1
    out = []
    for i, f in enumerate(first):
        s = {"k": None if null[f] else k[f], "n": int(rows[i]), "points": int(points[i]), "t0": None, "t1": None, "la0": None, "lo0": None, "la1": None, "lo1": None, "path": float(path[i])}
        if points[i]:
            a, b = at[lo_at[i]], at[hi_at[i]]
            s |= {"t0": int(t_int[a]), "t1": int(t_int[b]), "la0": la[a], "lo0": lo[a], "la1": la[b], "lo1": lo[b]}
        out.append(s)
    return out


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict | None = None
    slot = 0
    head = True  # the partition's first key, which may have begun before

    def frame(states: list[dict], opened: list[bool]) -> pd.DataFrame:
        d = pd.DataFrame(states, columns=["k", *_FIELDS])
        for c in ("t0", "t1"):
            d[c] = pd.array([s[c] for s in states], dtype="Int64")
        return d.assign(slot=slot, open=opened)

    for batch in batches:
        if not len(batch):
            continue
        slot = int(batch["slot"].iloc[0])
        states = _states(batch)
        if kept is not None and kept["k"] == states[0]["k"]:
            states[0] = _append(kept, states[0])
        elif kept is not None:
            states.insert(0, kept)
        kept = states.pop()
        if states:
            opened = [head, *[False] * (len(states) - 1)]
            head = False
            yield frame(states, opened)
    if kept is not None:
        yield frame([kept], [True])


def _merged(states: Column) -> Column:
    """A struct of the merged states of an ordered array of at most ``fan_in``."""

    def join(a: Column, b: Column) -> Column:
        la1, lo1, la2, lo2 = (F.radians(x) for x in (a["la1"], a["lo1"], b["la0"], b["lo0"]))
        h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
        step = 2 * 6371000.0 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
        late, early = b["points"] > 0, a["points"] > 0
        pick = lambda x, y: F.when(late, y).otherwise(x)
        return F.struct(
            (a["n"] + b["n"]).alias("n"), (a["points"] + b["points"]).alias("points"),
            *(F.when(early, a[c]).otherwise(b[c]).alias(c) for c in ("t0",)), pick(a["t1"], b["t1"]).alias("t1"),
            *(F.when(early, a[c]).otherwise(b[c]).alias(c) for c in ("la0", "lo0")),
            pick(a["la1"], b["la1"]).alias("la1"), pick(a["lo1"], b["lo1"]).alias("lo1"),
            (a["path"] + b["path"] + F.when(early & late, step).otherwise(0.0)).alias("path"),
        )

    return F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(1))), F.element_at(states, 1), join)


def _unordered(pings: DataFrame, fan_in: int) -> DataFrame:
    """``k, n, points, t0, t1`` of every key by rounds over the chunks of the input."""
    point = F.col("t").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    chunks = pings.select("k", F.spark_partition_id().alias("slot"), F.when(point, F.col("t")).alias("t"))
    merge = [F.sum("n").alias("n"), F.sum("points").alias("points"), F.min("t0").alias("t0"), F.max("t1").alias("t1")]
    first = chunks.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int")).groupBy("k", "slot")
    # written once: few rows, and their chunks tell how many rounds are needed
    up = reliable(first.agg(F.count("*").alias("n"), F.count("t").alias("points"), F.min("t").alias("t0"), F.max("t").alias("t1")))
    span = (up.agg(F.max("slot")).first()[0] or 0) + 1
    while span > 1:
        span = math.ceil(span / fan_in)
        up = up.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int")).groupBy("k", "slot").agg(*merge)
    return up.drop("slot")


def tree_profile(
    df: DataFrame,
    key: str = "traj_id",
    time: str = "DateTime",
    lat: str = "lat",
    lon: str = "lon",
    row_id: str = "row_id",
    fan_in: int = 16,
    rows_per_partition: int = ROWS_PER_BLOCK,
    distance: bool = True,
) -> DataFrame:
    """``traj_id, n_rows, n_points, first_us, last_us, duration_s`` and, with ``distance``, ``distance_m`` for every key.

    Points are the rows with time and both coordinates (null and NaN are missing), in order of time and row id.
    Rows without a key make one row with a null key. An empty table gives no rows.
    """
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pings = df.select(F.col(key).cast("string").alias("k"), micros(time).alias("t"), clean(lat).alias("lat"), clean(lon).alias("lon"), F.col(row_id).alias("r"))
    told = lambda x: x.select(
        F.col("k").alias("traj_id"), F.col("n").alias("n_rows"), F.col("points").alias("n_points"), F.col("t0").alias("first_us"), F.col("t1").alias("last_us"),
        ((F.col("t1") - F.col("t0")) / 1e6).alias("duration_s"), *([F.col("path").alias("distance_m")] if distance else []),
    )
    if not distance:
        return told(_unordered(pings, fan_in))
    rows = df.count()
    parts = max(math.ceil(rows / rows_per_partition), min(shuffle_partitions(df), math.ceil(rows / 4000)), 1)
    chunks = pings.repartitionByRange(parts, "k", "t", "r").sortWithinPartitions("k", "t", "r").select("k", "t", "lat", "lon", F.spark_partition_id().alias("slot"))
    # few rows, written once: both uses below must see the same cut into partitions
    states = reliable(chunks.mapInPandas(_local, f"k string, {_STATE}, slot int, open boolean"))
    body = ["k", *_FIELDS]
    closed = states.where(~F.col("open")).select(body)
    if parts == 1:
        return told(states.select(body))
    up, span = states.where("open").select("slot", F.lit(0).alias("part"), *body), parts
    while span > 1:
        span = math.ceil(span / fan_in)
        # a partition that holds one key only gives that key's state alone, so the slot orders the states
        group = up.groupBy("k", F.floor(F.col("slot") / fan_in).cast("int").alias("s")).agg(F.array_sort(F.collect_list(F.struct("slot", *_FIELDS))).alias("x"))
        up = group.select("k", F.col("s").alias("slot"), F.when(F.size("x") > 1, _merged(F.transform("x", lambda e: F.struct(*(e[f].alias(f) for f in _FIELDS))))).otherwise(F.transform("x", lambda e: F.struct(*(e[f].alias(f) for f in _FIELDS)))[0]).alias("m")).select("k", "slot", "m.*")
    return told(closed.unionByName(up.select(body)))
