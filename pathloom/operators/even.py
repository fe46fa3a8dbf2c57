"""Windows along a trajectory without one task for a giant one.

A window over ``partitionBy(traj_id)`` is right for many trajectories, but puts one with a third of all rows into a
single task. Where some trajectory has more than ``GIANT`` rows, the giants are cut into chunks of time with about
equal numbers of rows, and each chunk also gets copies ("ghosts") of the few rows before and after it that the windows
look at. Windows then run over (trajectory, chunk), the ghosts go afterwards, and the results are equal to the last bit.
What a chunk cannot see (the first row of the trajectory) travels as a column.

The counts take one pass over the ids, before the operator returns; a table whose estimated size is under ``SMALL`` bytes
is not counted. ``giant=None`` turns the check off.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.blocks import reliable
from pathloom.schema import ROW, TIME, TRAJ, ordered

GIANT = 2_000_000  # rows of one trajectory; a window of so many rows takes some seconds in a task
SMALL = 8 << 20
CHUNK, GHOST, ORIGIN = "_chunk", "_ghost", "_origin"
_BIN = "_bin"


def _size(df: DataFrame) -> float:
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a client without the plan
        return float("inf")


def giants(df: DataFrame, keys: list[str], giant: int | None) -> DataFrame | None:
    """The keys with more than ``giant`` rows (at most rows / giant of them), or ``None`` if there are none."""
    if giant is None or CHUNK in keys or df.isStreaming or (giant >= GIANT and _size(df) < SMALL):
        return None
    large = reliable(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > int(giant)).drop("_n"))
    return None if large.isEmpty() else large


def _renamed(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, Callable[[DataFrame], Column]]:
    """The keys of a side table under other names, and the null-safe condition that joins it."""
    mine = {k: f"_{name}_{i}" for i, k in enumerate(keys)}
    return df.withColumnsRenamed(mine), lambda left: functools.reduce(lambda a, b: a & b, (left[k].eqNullSafe(F.col(m)) for k, m in mine.items()))


def spread(df: DataFrame, large: DataFrame, keys: list[str], before: int, after: int = 0, origin: tuple[str, ...] = (), giant: int = GIANT) -> DataFrame:
    """``df`` with ``_chunk``, ``_ghost`` and ``_origin`` (the columns ``origin`` of the key's first row; null for keys that
    are no giants).

    A chunk is a run of hours that holds about ``giant / 2`` rows, so what lies within one hour stays together.
    """
    hour = F.coalesce(F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(TIME)) / 3600), F.lit(-(1 << 60)))  # rows without a time come first
    rows = df.withColumn(_BIN, hour)
    side, on = _renamed(large, keys, "l")
    ours = rows.join(side, on(rows), "left_semi")
    heads = F.min_by(F.struct(*(F.col(f"`{c}`") for c in origin)), F.struct(TIME, ROW)) if origin else F.lit(True)
    bins = ours.groupBy(*keys, _BIN).agg(F.count("*").alias("_n"), heads.alias("_head") if origin else F.max(heads).alias("_head"))
    w = Window.partitionBy(*keys).orderBy(_BIN)  # hours of a giant
    prior = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = reliable(bins.select(*keys, _BIN, F.floor(prior / max(int(giant) // 2, 1)).alias(CHUNK), F.first("_head").over(w).alias(ORIGIN)))
    place, on = _renamed(bins, [*keys, _BIN], "b")
    drop = [c for c in place.columns if c not in (CHUNK, ORIGIN)]
    tagged = rows.join(place, on(rows), "left").withColumns({CHUNK: F.coalesce(CHUNK, F.lit(0)), GHOST: F.lit(False)}).drop(_BIN, *drop)
    # the last rows of each chunk for the chunks after it, the first ones for the chunks before it
    inner = tagged.join(_renamed(large, keys, "g")[0], _renamed(large, keys, "g")[1](tagged), "left_semi")
    every = [F.col(f"`{c}`") for c in tagged.columns]
    out = tagged
    for depth, step in ((before, 1), (after, -1)):
        if not depth:
            continue
        order = (F.desc(TIME), F.desc(ROW)) if step > 0 else (F.asc(TIME), F.asc(ROW))
        rank = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order))
        ends = inner.withColumn("_rank", rank).where(F.col("_rank") <= depth)
        own = ends.groupBy(*keys, CHUNK).agg(*(F.first(F.when(F.col("_rank") == i, F.struct(*every)), ignorenulls=True).alias(f"_r{i}") for i in range(1, depth + 1)))
        own = own.withColumn("_own", F.filter(F.array(*(f"_r{i}" for i in range(1, depth + 1))), lambda x: x.isNotNull()))  # nearest first
        outer = Window.partitionBy(*keys).orderBy(F.col(CHUNK) * step).rowsBetween(-depth, -1)  # one row a chunk
        near = own.withColumn("_near", F.slice(F.flatten(F.reverse(F.collect_list("_own").over(outer))), 1, depth))
        ghosts = near.select(F.col(CHUNK).alias("_to"), F.explode("_near").alias("x"))
        out = out.unionByName(ghosts.select(*(F.col("_to").alias(CHUNK) if c == CHUNK else F.lit(True).alias(GHOST) if c == GHOST else F.col(f"x.`{c}`").alias(c) for c in tagged.columns)))
    return out


def settle(df: DataFrame) -> DataFrame:
    """Without ghosts and helpers."""
    return df.where(~F.col(GHOST)).drop(CHUNK, GHOST, ORIGIN)


def of_origin(df: DataFrame, name: str, otherwise: Column) -> Column:
    """A value of the key's first row: from the giant's column, or by a window that sees the whole key."""
    return F.when(F.col(ORIGIN).isNotNull(), F.col(f"{ORIGIN}.`{name}`")).otherwise(otherwise) if ORIGIN in df.columns else otherwise


def even(before: int, after: int = 0, origin: tuple[str, ...] = ()) -> Callable:
    """For operators ``f(df, *within)`` whose windows over (trajectory, ``within``) look at so many rows before and after."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def call(df: DataFrame, *within: str, giant: int | None = GIANT, **more) -> DataFrame:
            if giant is None:
                return f(df, *within, **more)
            df = ordered(df)
            keys = [TRAJ, *within]
            large = giants(df, keys, giant)
            if large is None:
                return f(df, *within, **more)
            return settle(f(spread(df, large, keys, before, after, origin, giant), *within, CHUNK, **more))

        return call

    return wrap
