"""Exact quantiles of a whole column, or of each group, without one task that holds it.

Values are range-partitioned and sorted; blocks report their row counts, which give the block and place of every
wanted rank; a second pass over the same blocks picks those values. Linear interpolation between ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.blocks import BLOCK, ROWS_PER_BLOCK, OrderedBlocks, reliable


def exact_quantiles(df: DataFrame, value: Column, probabilities: list[float]) -> list[float | None]:
    """Quantiles of the non-null values; ``None`` for each if there are none."""
    # written once: whatever the column is derived from is computed once, not for each pass
    blocks = OrderedBlocks(reliable(df.select(value.cast("double").alias("v")).where("v IS NOT NULL")), ["v"], [])
    sizes = blocks.reports(lambda b: pd.DataFrame({"n": [len(b)]}), "n long")
    total = int(sizes["n"].sum())
    if not total:
        return [None] * len(probabilities)
    ranks = sorted({r for p in probabilities for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
    first, begin = {}, 0
    for b, n in zip(sizes[BLOCK], sizes["n"]):
        first[int(b)] = begin
        begin += int(n)

    def pick(block: pd.DataFrame, number: int) -> pd.DataFrame:
        mine = [r for r in ranks if 0 <= r - first[number] < len(block)]
        return pd.DataFrame({"r": mine, "v": [float(block["v"].iloc[r - first[number]]) for r in mine]}).astype({"r": "int64", "v": "float64"})

    got = {r["r"]: r["v"] for r in blocks.map(pick, "r long, v double").collect()}  # two rows per probability
    out = []
    for p in probabilities:
        at = p * (total - 1)
        lo, hi = got[math.floor(at)], got[math.ceil(at)]
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def grouped_quantiles(df: DataFrame, group: str, value: str, probabilities: list[float], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``group, q`` (array in the order of ``probabilities``) of the non-null values of each group, however large.

    Rows are range-partitioned by (group, value). Groups within one block are settled there; of the others (at most two
    per block) the driver knows the counts per block, so each block picks the ranks that fall into it.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    blocks = OrderedBlocks(rows, ["g", "v"], [], rows_per_block=rows_per_block)

    def ends(b: pd.DataFrame) -> pd.DataFrame:
        g = b["g"].to_numpy()
        names = [g[0]] if g[0] == g[-1] else [g[0], g[-1]]
        return pd.DataFrame({"g": names, "n": [int((g == x).sum()) for x in names]})

    report = blocks.reports(ends, "g string, n long")
    spread = report.groupby("g").filter(lambda x: len(x) > 1)
    total = spread.groupby("g")["n"].sum().to_dict()
    before = {(int(b), g): int(c) for b, g, c in zip(spread[BLOCK], spread["g"], spread.groupby("g")["n"].cumsum() - spread["n"])}

    def pick(b: pd.DataFrame, number: int) -> pd.DataFrame:
        g, v = b["g"].to_numpy(), b["v"].to_numpy()
        cut = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        out = []
        for s, e in zip(cut, cut[1:]):
            n, begin = total.get(g[s], e - s), before.get((number, g[s]), 0)
            for i, p in enumerate(probabilities):
                at = p * (n - 1)
                lo, hi = math.floor(at), math.ceil(at)
                part = at - lo
                for rank, weight in ((lo, 1 - part), (hi, part)):
                    if 0 <= rank - begin < e - s and (weight or rank == lo):
                        out.append((g[s], i, float(v[s + rank - begin]) * weight))
                        if hi == lo:
                            break
        return pd.DataFrame(out, columns=["g", "i", "x"]).astype({"i": "int32", "x": "float64"})

    # two terms per probability and group
    terms = blocks.map(pick, "g string, i int, x double").groupBy("g", "i").agg(F.sum("x").alias("x"))
    return terms.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("q")).withColumnRenamed("g", group)
