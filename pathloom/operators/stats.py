"""Segments by days, and summary statistics per trajectory or segment.

Statistics are aggregated wide, on the partitioning that the feature windows already have, and turned long
afterwards; points are never multiplied by the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.even import GIANT, giants
from pathloom.operators.kinematic import generate_kinematic_features
from pathloom.operators.linked import generate_kinematic_features_chunked
from pathloom.operators.quantiles import exact_quantiles, grouped_quantiles
from pathloom.schema import FEATURES, LAT, LON, TIME, TRAJ, need, ordered

PERCENTS = {"10%": 0.1, "25%": 0.25, "50%": 0.5, "75%": 0.75, "90%": 0.9}
STATS = ("10%", "25%", "50%", "75%", "90%", "min", "max", "mean", "std")
SEG = "seg_id"


def segment_traj_by_days(df: DataFrame, num_days: int, mode: str = "cumulative") -> DataFrame:
    """Rows with ``Date`` and ``seg_id`` (from 1).

    ``cumulative``: segment k holds all rows from day (k - 1) * num_days of the trajectory on, for as many k as begin
    before its end; trajectories shorter than num_days give none. ``disjoint``: each row in its own period only.
    """
    need(df, TRAJ, TIME)
    df = ordered(df)
    span = df.groupBy(TRAJ).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_z")).withColumnRenamed(TRAJ, "_id")
    rows = df.withColumn("Date", F.to_date(TIME)).join(span, F.col(TRAJ) == F.col("_id"))
    period = F.floor(F.datediff("Date", F.to_date("_a")) / int(num_days)).cast("int") + 1
    if mode == "disjoint":
        return rows.withColumn(SEG, period).drop("_id", "_a", "_z")
    if mode != "cumulative":
        raise ValueError(f"unknown mode {mode!r}")
    length = F.timestamp_diff("MICROSECOND", F.col("_a"), F.col("_z")) / F.lit(86400e6 * int(num_days))
    most = F.least(F.ceil(length).cast("int") - 1, period)
    return rows.where(most >= 1).withColumn(SEG, F.explode(F.sequence(F.lit(1), most))).drop("_id", "_a", "_z")


def _summaries(target: str) -> list[Column]:
    out = []
    for f in FEATURES:
        out += [F.min(f).alias(f"{f}__min"), F.max(f).alias(f"{f}__max"), F.avg(f).alias(f"{f}__mean"), F.stddev_samp(f).alias(f"{f}__std")]
    return [*out, F.min_by(F.col(f"`{target}`"), F.struct(TIME, "row_id")).alias(target)]


def _wide(df: DataFrame, target: str, segmented: bool, compat: bool, giant: int) -> tuple[DataFrame, list[str]]:
    keys = [TRAJ, SEG] if segmented else [TRAJ]
    need(df, target, *keys)
    plain = ordered(df.drop(*FEATURES))
    large = giants(plain, keys, giant)
    some = large is not None
    usual = plain.join(large, keys, "left_anti") if some else plain
    full = generate_kinematic_features(usual, *keys[1:], compat=compat, giant=None)
    exact = [F.percentile(f, F.array(*(F.lit(p) for p in PERCENTS.values()))).alias(f"{f}__p") for f in FEATURES]
    wide = full.groupBy(*keys).agg(*exact, *_summaries(target))
    if some:
        wide = wide.unionByName(_giants(plain.join(large, keys, "left_semi"), keys, target, compat))
    return wide, keys


def _giants(df: DataFrame, keys: list[str], target: str, compat: bool) -> DataFrame:
    """The same for trajectories too large for one task: features by time chunks, sums by partial aggregation, quantiles
    from even blocks of sorted values."""
    name = F.to_json(F.struct(*keys))
    one = df.withColumns({f"_key_{k}": F.col(k) for k in keys}).withColumn(TRAJ, name)
    full = generate_kinematic_features_chunked(one)
    if compat:
        full = full.withColumn("Rate_of_bearing_rate", F.col("Bearing_Rate"))
    sums = full.groupBy(TRAJ).agg(*(F.first(f"_key_{k}").alias(f"_key_{k}") for k in keys), *_summaries(target))
    values = full.select(TRAJ, F.posexplode(F.array(*FEATURES)).alias("f", "v")).select(F.concat_ws("|", F.col("f"), F.col(TRAJ)).alias("g"), "v")
    q = grouped_quantiles(values, "g", "v", list(PERCENTS.values()))
    part = F.split("g", "\\|", 2)
    per = q.select(part[1].alias(TRAJ), part[0].cast("int").alias("f"), "q").groupBy(TRAJ).agg(*(F.first(F.when(F.col("f") == i, F.col("q")), ignorenulls=True).alias(f"{f}__p") for i, f in enumerate(FEATURES)))
    met = sums.join(per, TRAJ, "left").drop(TRAJ)
    return met.withColumnsRenamed({f"_key_{k}": k for k in keys})


def generate_kinematic_stats(df: DataFrame, target_col_name: str, segmented: bool = False, compat: bool = False, giant: int = GIANT) -> DataFrame:
    """Long form: one row per trajectory (and segment) and feature, with the nine statistics and the first label.

    Quantiles are exact. Trajectories of more than ``giant`` points take a path that never gathers one in a task.
    """
    wide, keys = _wide(df, target_col_name, segmented, compat, giant)
    rows = F.array(*(
        F.struct(
            F.lit(f).alias("Columns"), *(F.get(f"{f}__p", i).alias(name) for i, name in enumerate(PERCENTS)),
            *(F.col(f"{f}__{s}").alias(s) for s in ("min", "max", "mean", "std")),
        ) for f in FEATURES
    ))
    return wide.select(*keys, target_col_name, F.explode(rows).alias("x")).select(*keys, "x.*", target_col_name)


def generate_pivoted_stats(df: DataFrame, target_col_name: str, segmented: bool = False, compat: bool = False, giant: int = GIANT) -> DataFrame:
    """``pivot_stats_df(generate_kinematic_stats(...))`` without the way through the long form."""
    wide, keys = _wide(df, target_col_name, segmented, compat, giant)
    at = {name: (lambda f, i=i: F.get(f"{f}__p", i)) for i, name in enumerate(PERCENTS)} | {s: (lambda f, s=s: F.col(f"{f}__{s}")) for s in ("min", "max", "mean", "std")}
    return wide.select(*keys, *(at[s](f).alias(f"{s}_{f}") for f in FEATURES for s in STATS), target_col_name)


def pivot_stats_df(stats: DataFrame, target_col_name: str, segmented: bool = False) -> DataFrame:
    """Wide form of ``generate_kinematic_stats``: ``{stat}_{feature}`` in a fixed order, then the label."""
    keys = [TRAJ, SEG] if segmented else [TRAJ]
    need(stats, "Columns", target_col_name, *keys)
    table = stats.groupBy(*keys).pivot("Columns", list(FEATURES)).agg(*(F.first(f"`{s}`").alias(s) for s in STATS), F.first(f"`{target_col_name}`").alias("_label"))
    cols = [F.col(f"`{f}_{s}`").alias(f"{s}_{f}") for f in FEATURES for s in STATS]
    label = F.coalesce(*(F.col(f"`{f}__label`") for f in FEATURES)).alias(target_col_name)
    return table.select(*keys, *cols, label)


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Percentiles, mean, deviation and extremes of one column of the whole table, in one row."""
    need(df, column)
    got = exact_quantiles(df, F.col(f"`{column}`"), list(PERCENTS.values()))
    out = df.agg(F.count(f"`{column}`").alias("count"), F.avg(f"`{column}`").alias("mean"), F.stddev_samp(f"`{column}`").alias("std"), F.min(f"`{column}`").alias("min"), F.max(f"`{column}`").alias("max"))
    return out.withColumns({name: F.lit(v).cast("double") for name, v in zip(PERCENTS, got)})


def feature_importance(df: DataFrame, target: str, features: tuple[str, ...] = (*FEATURES, LAT, LON), bins: int = 16, top: int | None = None) -> DataFrame:
    """``feature, mutual_information`` (nats) between each feature and a class label, of the ``top`` features or all.

    Rows that lack the label or any of the features are left out, so all features are measured on the same rows. Features
    are cut into ``bins`` of about equal counts by quantiles (mergeable sketches, a rank's error is 1/10,000 of the rows at most); the
    information comes from counts per (feature, bin, class). No such rows: every feature has none, so there is no result.
    """
    need(df, target, *features)
    number = lambda f: F.col(f"`{f}`").cast("double")
    whole = df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string").alias("y"), *(F.when(~F.isnan(number(f)), number(f)).alias(f"f{i}") for i, f in enumerate(features))).na.drop("any")
    cuts = whole.agg(*(F.percentile_approx(f"f{i}", [j / bins for j in range(1, bins)], 10000).alias(f"f{i}") for i in range(len(features)))).first()
    parts = [F.struct(F.lit(f).alias("feature"), sum((F.when(F.col(f"f{i}") > c, 1).otherwise(0) for c in sorted(set(cuts[f"f{i}"] or []))), F.lit(0)).alias("bin")) for i, f in enumerate(features)]
    joint = whole.select("y", F.explode(F.array(*parts)).alias("x")).groupBy("x.feature", "x.bin", "y").agg(F.count("*").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    terms = joint.withColumns({"nx": by("feature", "bin"), "ny": by("feature", "y"), "all": by("feature")})
    out = terms.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))
    return out if top is None else out.orderBy(F.desc("mutual_information"), "feature").limit(int(top))
