"""One query for each operator of the survey over the test tables, with the SQL that must give the same rows.

Features are rounded (derivatives after scaling), because two engines' trigonometry differs in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import aggregates as A
from pathloom.operators import contextual as C
from pathloom.operators import filters as Fi
from pathloom.operators import interpolate as I
from pathloom.operators import kinematic as K
from pathloom.operators import linked as L
from pathloom.operators import stats as S
from pathloom.operators import temporal as T
from pathloom.operators import views as V
from pathloom.schema import FEATURES

CENTER = (40.5, -74.5)
RATE = 14400
POLYGON = [(-75.0, 40.1), (-74.2, 40.2), (-73.9, 40.6), (-74.3, 40.9), (-74.9, 40.7)]
BOX = (40.2, -74.8, 40.7, -74.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").cast("string").alias("traj_id"), F.col("ts").alias("DateTime"), F.col("event_id").alias("row_id"),
        (F.lit(40.0) + F.col("event_id") % 97 / F.lit(100.0)).alias("lat"), (F.lit(-75.0) + F.col("user_id") % 13 / F.lit(10.0) + F.col("value") / F.lit(1000.0)).alias("lon"),
        "event_type", "value",
    )


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumns({"lat": F.round("lat", 1), "lon": F.round("lon", 1)})


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", (F.lit(40.0) + F.col("s_suppkey") % 10 / F.lit(10.0)).alias("lat"), (F.lit(-75.0) + F.col("s_suppkey") % 13 / F.lit(10.0)).alias("lon"), F.abs("s_acctbal").alias("far"), F.col("s_nationkey"))


def animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.schema import as_trajectories

    return as_trajectories(spark.read.parquet(f"{sf_dir}/animal_points.parquet"))


def herd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with animal-like ids, whose letter names the species."""
    letter = F.element_at(F.array(F.lit("D"), F.lit("E"), F.lit("C")), (F.col("traj_id").cast("int") % 3 + 1).cast("int"))
    return points(spark, sf_dir).withColumn("traj_id", F.concat("traj_id", letter))


def pastures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled places among the points, some of them water."""
    eco = F.when(F.col("s_nationkey") % 3 == 0, "WR").otherwise("GR")
    return pois(spark, sf_dir).select("lat", "lon", F.concat(F.lit("pasture "), (F.col("s_suppkey") % 7).cast("string")).alias("CowPast"), eco.alias("EcoGener"), (F.col("s_suppkey") % 2).cast("double").alias("DistEWat"))


def habitat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/habitat.parquet")


def r(name: str, scale: float = 1.0, digits: int = 6, alias: str | None = None) -> Column:
    v = F.col(f"`{name}`")
    return F.round(v * scale if scale != 1.0 else v, digits).alias(alias or name)


# scale and digits with which each feature is compared
ROUND = {"Distance": (1.0, 3), "Distance_from_start": (1.0, 3), "Speed": (1.0, 6), "Acceleration": (1e6, 4), "Jerk": (1e6, 4), "Bearing": (1.0, 6), "Bearing_Rate": (1e3, 5), "Rate_of_bearing_rate": (1e6, 4)}

PTS = """pts AS (
  SELECT CAST(user_id AS VARCHAR) AS traj_id, ts AS "DateTime", event_id AS row_id,
    40.0::DOUBLE + (event_id % 97)::DOUBLE / 100.0::DOUBLE AS lat,
    -75.0::DOUBLE + (user_id % 13)::DOUBLE / 10.0::DOUBLE + value / 1000.0::DOUBLE AS lon, event_type, value FROM events)"""
COARSE = PTS + ", coarse AS (SELECT * REPLACE (round(lat, 1) AS lat, round(lon, 1) AS lon) FROM pts)"
W = "(PARTITION BY traj_id ORDER BY \"DateTime\", row_id)"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})) * 1000)"


def bear(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))"
    t = f"degrees(atan2({y}, {x}))"
    return f"(CASE WHEN {t} < 0 THEN {t} + 360 ELSE {t} END)"


def features(source: str = "pts", key: str = "traj_id") -> str:
    """CTEs that end in ``feat`` with all eight features (and ``br_compat``)."""
    w = f'(PARTITION BY {key} ORDER BY "DateTime", row_id)'
    dt = "nullif(date_diff('microsecond', t0, \"DateTime\"), 0) / 1e6::DOUBLE"
    return f"""f0 AS (SELECT *, lag(lat) OVER {w} AS la0, lag(lon) OVER {w} AS lo0, lag("DateTime") OVER {w} AS t0,
    first_value(lat) OVER {w} AS las, first_value(lon) OVER {w} AS los, row_number() OVER {w} AS rn FROM {source}),
f1 AS (SELECT *, {hav('la0', 'lo0', 'lat', 'lon')} AS "Distance", CASE WHEN rn > 1 THEN {hav('las', 'los', 'lat', 'lon')} END AS "Distance_from_start",
    {bear('la0', 'lo0', 'lat', 'lon')} AS "Bearing", {dt} AS dt FROM f0),
f2 AS (SELECT *, "Distance" / dt AS "Speed", ("Bearing" - lag("Bearing") OVER {w}) / dt AS "Bearing_Rate" FROM f1),
f3 AS (SELECT *, ("Speed" - lag("Speed") OVER {w}) / dt AS "Acceleration", ("Bearing_Rate" - lag("Bearing_Rate") OVER {w}) / dt AS "Rate_of_bearing_rate" FROM f2),
feat AS (SELECT *, ("Acceleration" - lag("Acceleration") OVER {w}) / dt AS "Jerk" FROM f3)"""


def sql_round(name: str) -> str:
    scale, digits = ROUND[name]
    return f'round("{name}" * {scale:.0f}::DOUBLE, {digits}) AS "{name}"'


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = sql


def _feature(name: str, make: Callable[[DataFrame], DataFrame], column: str, sql: str | None = None) -> None:
    scale, digits = ROUND[column]
    body = sql or f"WITH {PTS}, {features()} SELECT row_id, {sql_round(column)} FROM feat"
    add(name, lambda s, d: make(points(s, d)).select("row_id", r(column, scale, digits)), body)


# --- kinematic -----------------------------------------------------------------------------------------------------
_feature("distance", K.create_distance_column, "Distance")
_feature("distance_from_start", K.create_distance_from_start_column, "Distance_from_start")
_feature("speed", K.create_speed_column, "Speed")
_feature("acceleration", K.create_acceleration_column, "Acceleration")
_feature("jerk", K.create_jerk_column, "Jerk")
_feature("bearing", K.create_bearing_column, "Bearing")
_feature("bearing_rate", K.create_bearing_rate_column, "Bearing_Rate")
_feature("rate_of_bearing_rate", K.create_rate_of_br_column, "Rate_of_bearing_rate")
_feature(
    "rate_of_bearing_rate_compat", lambda p: K.create_rate_of_br_column(p, compat=True), "Rate_of_bearing_rate",
    f'WITH {PTS}, {features()} SELECT row_id, round("Bearing_Rate" * 1000000::DOUBLE, 4) AS "Rate_of_bearing_rate" FROM feat',
)
add(
    "distance_from_point", lambda s, d: K.create_distance_from_point_column(points(s, d), CENTER).select("row_id", r(f"Distance_from_{CENTER}", digits=3, alias="metres")),
    f"WITH {PTS} SELECT row_id, round({hav('40.5::DOUBLE', '-74.5::DOUBLE', 'lat', 'lon')}, 3) AS metres FROM pts",
)
add(
    "within_range", lambda s, d: K.create_point_within_range_column(points(s, d), CENTER, 30000).select("row_id", F.col("`Within_30000_m`").alias("within")),
    f"WITH {PTS} SELECT row_id, {hav('40.5::DOUBLE', '-74.5::DOUBLE', 'lat', 'lon')} <= 30000 AS within FROM pts",
)
add(
    "kinematic_all", lambda s, d: K.generate_kinematic_features(points(s, d)).select("row_id", *(r(f, *ROUND[f]) for f in FEATURES)),
    f"WITH {PTS}, {features()} SELECT row_id, {', '.join(sql_round(f) for f in FEATURES)} FROM feat",
)

add("kinematic_all_chunked", lambda s, d: L.generate_kinematic_features_chunked(points(s, d), 7 * 86400).select("row_id", *(r(f, *ROUND[f]) for f in FEATURES)), ORACLES["kinematic_all"])
# every trajectory of more than 30 points is a giant
add("kinematic_all_even", lambda s, d: K.generate_kinematic_features(points(s, d), giant=30).select("row_id", *(r(f, *ROUND[f]) for f in FEATURES)), ORACLES["kinematic_all"])

# --- aggregates ----------------------------------------------------------------------------------------------------
add("bounding_box", lambda s, d: A.bounding_box(points(s, d)), f"WITH {PTS} SELECT min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts")
add("start_location", lambda s, d: A.get_start_location(points(s, d)), f"WITH {PTS}, o AS (SELECT *, row_number() OVER {W} AS rn FROM pts) SELECT traj_id, lat, lon FROM o WHERE rn = 1")
add(
    "end_location", lambda s, d: A.get_end_location(points(s, d)),
    f"WITH {PTS}, o AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY \"DateTime\" DESC, row_id) AS rn FROM pts) SELECT traj_id, lat, lon FROM o WHERE rn = 1",
)
add("start_time", lambda s, d: A.get_start_time(points(s, d)), f'WITH {PTS} SELECT traj_id, min("DateTime") AS "DateTime" FROM pts GROUP BY traj_id')
add("end_time", lambda s, d: A.get_end_time(points(s, d)), f'WITH {PTS} SELECT traj_id, max("DateTime") AS "DateTime" FROM pts GROUP BY traj_id')
add(
    "traj_duration", lambda s, d: A.get_traj_duration(points(s, d)).select("traj_id", "seconds"),
    f"WITH {PTS} SELECT traj_id, date_diff('microsecond', min(\"DateTime\"), max(\"DateTime\")) / 1e6::DOUBLE AS seconds FROM pts GROUP BY traj_id",
)
add(
    "n_locations", lambda s, d: A.get_number_of_locations(coarse(s, d)).withColumnRenamed("Number of Unique Coordinates", "n"),
    f"WITH {COARSE} SELECT traj_id, count(DISTINCT (lat, lon)) AS n FROM coarse GROUP BY traj_id",
)
add(
    "distance_by_traj", lambda s, d: A.distance_travelled(points(s, d)).select("traj_id", r("Distance", digits=3)),
    f'WITH {PTS}, {features()} SELECT traj_id, round(coalesce(sum("Distance"), 0), 3) AS "Distance" FROM feat GROUP BY traj_id',
)
add(
    "distance_by_date_traj", lambda s, d: A.distance_travelled_by_date(points(s, d)).select("traj_id", "Date", r("Distance", digits=3)),
    f'WITH {PTS}, days AS (SELECT *, CAST("DateTime" AS DATE) AS "Date" FROM pts), {features("days", "traj_id, \"Date\"")} SELECT traj_id, "Date", round(coalesce(sum("Distance"), 0), 3) AS "Distance" FROM feat GROUP BY ALL',
)
add(
    "dataset_facts", lambda s, d: A.dataset_facts(points(s, d)),
    f"""WITH {PTS} SELECT count(DISTINCT traj_id) AS n_trajectories, count(*) AS n_points, min("DateTime") AS start_time, max("DateTime") AS end_time,
  min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts""",
)
# ties in time, on orders: the smallest key counts
add(
    "start_location_ties",
    lambda s, d: A.get_start_location(
        s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("string").alias("traj_id"), F.col("o_orderdate").alias("DateTime"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("lat"), F.col("o_orderkey").cast("double").alias("lon"))
    ),
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT CAST(o_custkey AS VARCHAR) AS traj_id, o_totalprice AS lat, CAST(o_orderkey AS DOUBLE) AS lon FROM o WHERE rn = 1",
)

# --- temporal ------------------------------------------------------------------------------------------------------
DAY = "dayname(\"DateTime\")"
PART = "CASE WHEN hour(\"DateTime\") < 5 THEN 'Late Night' WHEN hour(\"DateTime\") < 9 THEN 'Early Morning' WHEN hour(\"DateTime\") < 13 THEN 'Morning' WHEN hour(\"DateTime\") < 17 THEN 'Noon' WHEN hour(\"DateTime\") < 21 THEN 'Evening' ELSE 'Night' END"
CLOCK = "CASE WHEN microsecond(\"DateTime\") % 1000000 = 0 THEN strftime(\"DateTime\", '%H:%M:%S') ELSE strftime(\"DateTime\", '%H:%M:%S.%f') END"
TEMPORAL = {"Date": 'CAST("DateTime" AS DATE)', "Time": CLOCK, "Day_Of_Week": DAY, "Weekend": f"{DAY} IN ('Saturday', 'Sunday')", "Time_Of_Day": PART}
for _name, _make, _col in (
    ("date", T.create_date_column, "Date"), ("time", T.create_time_column, "Time"), ("day_of_week", T.create_day_of_week_column, "Day_Of_Week"),
    ("weekend", T.create_weekend_indicator_column, "Weekend"), ("time_of_day", T.create_time_of_day_column, "Time_Of_Day"),
):
    add(_name, lambda s, d, make=_make, col=_col: make(points(s, d)).select("row_id", col), f'WITH {PTS} SELECT row_id, {TEMPORAL[_col]} AS "{_col}" FROM pts')
add("temporal_all", lambda s, d: T.generate_temporal_features(points(s, d)).select("row_id", *TEMPORAL), f"WITH {PTS} SELECT row_id, " + ", ".join(f'{v} AS "{k}"' for k, v in TEMPORAL.items()) + " FROM pts")


# --- filters -------------------------------------------------------------------------------------------------------
def _filter(name: str, make: Callable[[DataFrame], DataFrame], where: str, cte: str = "") -> None:
    add(name, lambda s, d: make(points(s, d)).select("row_id"), f"WITH {PTS}{', ' + cte if cte else ''} SELECT row_id FROM {'feat' if cte else 'pts'} WHERE {where}")


add(
    "dedupe", lambda s, d: Fi.remove_duplicates(points(s, d).unionByName(points(s, d).withColumn("row_id", F.col("row_id") + 10_000_000))).select("traj_id", "DateTime", "row_id", "lat", "lon", "event_type"),
    f'WITH {PTS} SELECT traj_id, "DateTime", min(row_id) AS row_id, lat, lon, arg_min(event_type, row_id) AS event_type FROM pts GROUP BY traj_id, "DateTime", lat, lon',
)
_filter("by_traj", lambda p: Fi.filter_by_traj_id(p, "7"), "traj_id = '7'")
_filter("bbox_in", lambda p: Fi.filter_by_bounding_box(p, BOX), "lat BETWEEN 40.2::DOUBLE AND 40.7::DOUBLE AND lon BETWEEN -74.8::DOUBLE AND -74.0::DOUBLE")
_filter("bbox_out", lambda p: Fi.filter_by_bounding_box(p, BOX, inside=False), "NOT (lat BETWEEN 40.2::DOUBLE AND 40.7::DOUBLE AND lon BETWEEN -74.8::DOUBLE AND -74.0::DOUBLE)")
_filter("by_date", lambda p: Fi.filter_by_date(p, "2024-01-05", "2024-01-12"), "CAST(\"DateTime\" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
_filter("by_datetime", lambda p: Fi.filter_by_datetime(p, "2024-01-05 06:00:00", "2024-01-12 18:30:00"), "\"DateTime\" BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'")
_filter("max_speed", lambda p: Fi.filter_by_max_speed(p, 1.0), '"Speed" <= 1.0', features())
_filter("min_speed", lambda p: Fi.filter_by_min_speed(p, 1.0), '"Speed" >= 1.0', features())
_filter("min_dist", lambda p: Fi.filter_by_min_consecutive_distance(p, 30000), '"Distance" >= 30000', features())
_filter("max_dist", lambda p: Fi.filter_by_max_consecutive_distance(p, 30000), '"Distance" <= 30000', features())
_filter("max_dist_speed", lambda p: Fi.filter_by_max_distance_and_speed(p, 30000, 1.0), '"Distance" <= 30000 AND "Speed" <= 1.0', features())
_filter("min_dist_speed", lambda p: Fi.filter_by_min_distance_and_speed(p, 30000, 1.0), '"Distance" >= 30000 AND "Speed" >= 1.0', features())
for _name, _col, _make in (("iqr_distance", "Distance", Fi.filter_outliers_by_consecutive_distance), ("iqr_speed", "Speed", Fi.filter_outliers_by_consecutive_speed)):
    _q = f'q AS (SELECT quantile_cont("{_col}", 0.25) AS q1, quantile_cont("{_col}", 0.75) AS q3 FROM feat)'
    add(_name, lambda s, d, make=_make: make(points(s, d)).select("row_id"), f'WITH {PTS}, {features()}, {_q} SELECT row_id FROM feat, q WHERE "{_col}" > q1 - 1.5 * (q3 - q1) AND "{_col}" < q3 + 1.5 * (q3 - q1)')
_filter("min_points", lambda p: Fi.remove_trajectories_with_less_points(p, 65), "traj_id IN (SELECT traj_id FROM pts GROUP BY traj_id HAVING count(*) >= 65)")
add(
    "hampel", lambda s, d: Fi.hampel_outlier_detection(points(s, d), "value").select("row_id"),
    f"""WITH {PTS}, v AS (SELECT *, list(value) OVER (PARTITION BY traj_id ORDER BY "DateTime", row_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS a FROM pts),
m AS (SELECT *, CASE WHEN len(a) = 10 THEN list_aggregate(a, 'median') END AS med FROM v),
s AS (SELECT *, CASE WHEN med IS NOT NULL THEN 1.4826::DOUBLE * list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median') END AS sig FROM m),
f AS (SELECT *, coalesce(first_value(med IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY "DateTime", row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(med IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY "DateTime", row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fm,
  coalesce(first_value(sig IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY "DateTime", row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(sig IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY "DateTime", row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fs FROM s)
SELECT row_id FROM f WHERE NOT coalesce(abs(value - fm) > 3 * fs, false)""",
)

# --- segments and statistics ---------------------------------------------------------------------------------------
_K = "least(CAST(ceil(date_diff('microsecond', a, z) / (7 * 86400e6::DOUBLE)) AS INTEGER) - 1, p)"
SEGMENTS = f"""spans AS (SELECT traj_id, min("DateTime") AS a, max("DateTime") AS z FROM pts GROUP BY traj_id),
placed AS (SELECT pts.*, a, z, CAST(floor(date_diff('day', CAST(a AS DATE), CAST("DateTime" AS DATE)) / 7.0::DOUBLE) AS INTEGER) + 1 AS p FROM pts JOIN spans USING (traj_id)),
segs AS (SELECT * EXCLUDE (a, z, p), unnest(generate_series(1, {_K}))::INTEGER AS seg_id FROM placed WHERE {_K} >= 1)"""
add("segment_cumulative", lambda s, d: S.segment_traj_by_days(points(s, d), 7).select("row_id", "seg_id"), f"WITH {PTS}, {SEGMENTS} SELECT row_id, seg_id FROM segs")
add("segment_disjoint", lambda s, d: S.segment_traj_by_days(points(s, d), 7, "disjoint").select("row_id", "seg_id"), f"WITH {PTS}, {SEGMENTS} SELECT row_id, p AS seg_id FROM placed")


def _stats_sql(source: str, keys: list[str]) -> str:
    head = f"{PTS}" + (f", {SEGMENTS}" if source == "segs" else "")
    per = ", ".join(keys)
    one = " UNION ALL ".join(
        f"SELECT {per}, '{f}' AS \"Columns\", " + ", ".join(f"round(quantile_cont(\"{f}\", {p}) * {ROUND[f][0]:.0f}::DOUBLE, 3) AS \"{n}\"" for n, p in S.PERCENTS.items())
        + "".join(f", round({fn}(\"{f}\") * {ROUND[f][0]:.0f}::DOUBLE, 3) AS \"{n}\"" for n, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp")))
        + f", arg_min(event_type, (\"DateTime\", row_id)) AS event_type FROM feat GROUP BY {per}"
        for f in FEATURES
    )
    return f"WITH {head}, {features(source, per)} {one}"


def _stats_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    scale = F.element_at(F.create_map(*(x for f in FEATURES for x in (F.lit(f), F.lit(ROUND[f][0])))), F.col("Columns"))
    return df.select(*keys, "Columns", *(F.round(F.col(f"`{s}`") * scale, 3).alias(s) for s in S.STATS), "event_type")


def kinematic_stats(s: SparkSession, d: str) -> DataFrame:
    return _stats_rows(S.generate_kinematic_stats(points(s, d), "event_type"), ["traj_id"])


def kinematic_stats_segmented(s: SparkSession, d: str) -> DataFrame:
    return _stats_rows(S.generate_kinematic_stats(S.segment_traj_by_days(points(s, d), 7), "event_type", segmented=True), ["traj_id", "seg_id"])


def pivot_stats(s: SparkSession, d: str) -> DataFrame:
    return _pivoted(S.generate_pivoted_stats(points(s, d), "event_type"))


def pivot_of_long_stats(s: SparkSession, d: str) -> DataFrame:
    return _pivoted(S.pivot_stats_df(S.generate_kinematic_stats(points(s, d), "event_type"), "event_type"))


def _pivoted(wide: DataFrame) -> DataFrame:
    return wide.select("traj_id", *(r(f"{st}_{f}", ROUND[f][0], 3, f"{st}_{f}".replace("%", "p")) for f in FEATURES for st in S.STATS), "event_type")


def _pivot_sql() -> str:
    calls = {**{n: f"quantile_cont(\"{{f}}\", {p})" for n, p in S.PERCENTS.items()}, "min": 'min("{f}")', "max": 'max("{f}")', "mean": 'avg("{f}")', "std": 'stddev_samp("{f}")'}
    cols = ", ".join(f"round({calls[st].format(f=f)} * {ROUND[f][0]:.0f}::DOUBLE, 3) AS \"{f'{st}_{f}'.replace('%', 'p')}\"" for f in FEATURES for st in S.STATS)
    return f'WITH {PTS}, {features()} SELECT traj_id, {cols}, arg_min(event_type, ("DateTime", row_id)) AS event_type FROM feat GROUP BY traj_id'


add("kinematic_stats", kinematic_stats, _stats_sql("pts", ["traj_id"]))
add("kinematic_stats_segmented", kinematic_stats_segmented, _stats_sql("segs", ["traj_id", "seg_id"]))
add("pivot_stats", pivot_stats, _pivot_sql())
add("pivot_of_long_stats", pivot_of_long_stats, _pivot_sql())
add(
    "describe_column", lambda s, d: S.describe_column(points(s, d), "value").select("count", *(r(c, digits=6, alias=c.replace("%", "p")) for c in ("mean", "std", "min", "max", *S.PERCENTS))),
    f"WITH {PTS} SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, "
    + ", ".join(f'round(quantile_cont(value, {p}), 6) AS "{n.replace("%", "p")}"' for n, p in S.PERCENTS.items()) + " FROM pts",
)
def importance(s: SparkSession, d: str) -> DataFrame:
    """Of the ten features of each point for its event type."""
    return S.feature_importance(K.generate_kinematic_features(points(s, d)), "event_type")


def importance_pivoted(s: SparkSession, d: str) -> DataFrame:
    """The ten statistics that tell most about a trajectory's label."""
    wide = S.generate_pivoted_stats(points(s, d), "event_type")
    return S.feature_importance(wide, "event_type", tuple(f"{st}_{f}" for f in FEATURES for st in S.STATS), bins=4, top=10)


add("feature_importance", lambda s, d: importance(s, d).select("feature", r("mutual_information", digits=9)))
add("feature_importance_pivoted", lambda s, d: importance_pivoted(s, d).select("feature", r("mutual_information", digits=9)))


# --- interpolation -------------------------------------------------------------------------------------------------
def _filled(kind: str, **more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: I.interpolate_position(points(s, d), RATE, kind, class_label_col="event_type", **more).select("traj_id", "DateTime", r("lat"), r("lon"), "event_type")


_GAPS = f"""g0 AS (SELECT *, lag(lat) OVER {W} AS la0, lag(lon) OVER {W} AS lo0, lag("DateTime") OVER {W} AS t0, first_value(event_type) OVER {W} AS label FROM pts),
g1 AS (SELECT *, date_diff('microsecond', t0, "DateTime") / 1e6::DOUBLE AS dt FROM g0)"""
_KEPT = 'SELECT traj_id, "DateTime", round(lat, 6) AS lat, round(lon, 6) AS lon, event_type FROM pts UNION ALL'
_AT = f"t0 + INTERVAL {RATE} SECOND"
add(
    "interpolate_linear", _filled("linear"),
    f"WITH {PTS}, {_GAPS} {_KEPT} SELECT traj_id, {_AT}, round(la0 + (lat - la0) * ({RATE}::DOUBLE / dt), 6), round(lo0 + (lon - lo0) * ({RATE}::DOUBLE / dt), 6), label FROM g1 WHERE dt > {RATE}",
)


def _kinematic_sql(t: str) -> str:
    def at(x0: str, x1: str, v0: str, v1: str) -> str:
        r1, r2 = f"({x1} - {x0} - {v0} * dt)", f"({v1} - {v0})"
        b, c = f"(6 * {r1} / (dt * dt) - 2 * {r2} / dt)", f"(6 * {r2} / (dt * dt) - 12 * {r1} / (dt * dt * dt))"
        return f"round({x0} + {v0} * {t} + {b} * {t} * {t} / 2 + {c} * {t} * {t} * {t} / 6, 6)"

    v = f'g2 AS (SELECT *, (lat - la0) / nullif(dt, 0) AS va, (lon - lo0) / nullif(dt, 0) AS vo FROM g1), g3 AS (SELECT *, lag(va) OVER {W} AS va0, lag(vo) OVER {W} AS vo0 FROM g2)'
    return f"WITH {PTS}, {_GAPS}, {v} {_KEPT} SELECT traj_id, {_AT}, {at('la0', 'lat', 'va0', 'va')}, {at('lo0', 'lon', 'vo0', 'vo')}, label FROM g3 WHERE dt > {RATE} AND va0 IS NOT NULL"


add("interpolate_kinematic", _filled("kinematic"), _kinematic_sql(f"{RATE}::DOUBLE"))
add("interpolate_kinematic_compat", _filled("kinematic", compat=True), _kinematic_sql(f"(date_diff('microsecond', TIMESTAMP '1970-01-01', {_AT}) / 1e6::DOUBLE / 1e10::DOUBLE)"))
add("interpolate_cubic", _filled("cubic"))
_U = lambda k: f"((('0x' || substr(md5(concat_ws('|', traj_id, '42', '{k}')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"
_N = lambda k: f"(sqrt(-2 * ln({_U(k)})) * cos(2 * pi() * {_U(k + 1)}))"
add(
    "interpolate_random_walk", _filled("random-walk"),
    f"""WITH {PTS}, {_GAPS}, {features()}, stat AS (SELECT traj_id, count(*) AS n, avg("Distance") AS md, stddev_samp("Distance") AS sd, avg("Bearing") AS mb, stddev_samp("Bearing") AS sb FROM feat GROUP BY traj_id),
draw AS (SELECT traj_id, md + sd * {_N(0)} AS a, radians(mb + sb * {_N(2)}) AS b FROM stat WHERE n > 3 AND sd IS NOT NULL AND sb IS NOT NULL)
{_KEPT} SELECT traj_id, {_AT}, round(la0 + degrees(a * cos(b) / 6371000), 6), round(lo0 + degrees(a * sin(b) / 6371000) / cos(radians(la0)), 6), label FROM g1 JOIN draw USING (traj_id) WHERE dt > {RATE}""",
)

# --- context -------------------------------------------------------------------------------------------------------
POIS = "pois AS (SELECT s_suppkey, 40.0::DOUBLE + (s_suppkey % 10)::DOUBLE / 10.0::DOUBLE AS lat, -75.0::DOUBLE + (s_suppkey % 13)::DOUBLE / 10.0::DOUBLE AS lon, abs(s_acctbal) AS far, s_nationkey FROM supplier)"
add(
    "visited_location", lambda s, d: C.visited_location(coarse(s, d), pois(s, d).withColumns({"lat": F.round("lat", 1), "lon": F.round("lon", 1), "name": F.lit("all")}), "all", "name").select("row_id", "Visited_all"),
    f"WITH {COARSE}, {POIS}, p AS (SELECT DISTINCT round(lat, 1) AS lat, round(lon, 1) AS lon FROM pois) SELECT row_id, CASE WHEN p.lat IS NULL THEN 0 ELSE 1 END AS \"Visited_all\" FROM coarse LEFT JOIN p ON p.lat = coarse.lat AND p.lon = coarse.lon",
)
add(
    "visited_poi", lambda s, d: C.visited_poi(points(s, d), pois(s, d), "far", 100.0).select("row_id", "Nearby_POI"),
    f"WITH {PTS}, {POIS} SELECT row_id, EXISTS (SELECT 1 FROM pois WHERE abs(far - {hav('pts.lat', 'pts.lon', 'pois.lat', 'pois.lon')}) <= 100) AS \"Nearby_POI\" FROM pts",
)
# the polygon is convex and counter-clockwise: inside is left of (or on) every edge
_HALVES = " AND ".join(f"({x2 - x1}::DOUBLE * (lat - {y1}::DOUBLE) - {y2 - y1}::DOUBLE * (lon - ({x1}::DOUBLE)) >= 0)" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
add("inside_polygon", lambda s, d: C.trajectories_inside_polygon(points(s, d), POLYGON).select("row_id"), f"WITH {PTS} SELECT row_id FROM pts WHERE {_HALVES}")
add(
    "intersect_in_polygon", lambda s, d: C.shared_places(coarse(s, d).where("event_type = 'click'"), coarse(s, d).where("event_type <> 'click'"), POLYGON),
    f"""WITH {COARSE}, i AS (SELECT * FROM coarse WHERE {_HALVES}),
a AS (SELECT lat, lon, count(*) AS points_1, count(DISTINCT traj_id) AS trajectories_1 FROM i WHERE event_type = 'click' GROUP BY lat, lon),
b AS (SELECT lat, lon, count(*) AS points_2, count(DISTINCT traj_id) AS trajectories_2 FROM i WHERE event_type <> 'click' GROUP BY lat, lon)
SELECT lat, lon, points_1, points_2, trajectories_1, trajectories_2 FROM a JOIN b USING (lat, lon)""",
)
add(
    "nearest_poi", lambda s, d: C.nearest_poi(pois(s, d).withColumn("tags", F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"))), (40.52, -74.48), 60000.0, {"nation": True}).select("s_suppkey", r("Distance", digits=4)),
    f"WITH {POIS}, m AS (SELECT s_suppkey, {hav('40.52::DOUBLE', '-74.48::DOUBLE', 'lat', 'lon')} AS x FROM pois) SELECT s_suppkey, round(x, 4) AS \"Distance\" FROM m WHERE x <= 60000 AND x - (SELECT min(x) FROM m) < 1e-6",
)
add(
    "herd", lambda s, d: C.herd_candidates(coarse(s, d), POLYGON, 3600),
    f"""WITH {COARSE}, i AS (SELECT * FROM coarse WHERE {_HALVES}) SELECT a.traj_id AS traj_id_1, a."DateTime" AS "DateTime_1", a.lat, a.lon, b.traj_id AS traj_id_2, b."DateTime" AS "DateTime_2"
FROM i a JOIN i b ON a.lat = b.lat AND a.lon = b.lon WHERE a.traj_id < b.traj_id AND abs(date_diff('microsecond', a."DateTime", b."DateTime")) <= 3600000000""",
)

# --- views ---------------------------------------------------------------------------------------------------------
_HERD = PTS + """, herd AS (SELECT * REPLACE (concat(traj_id, ['D', 'E', 'C'][CAST(traj_id AS INTEGER) % 3 + 1]) AS traj_id) FROM pts)"""
_SPECIES = "CASE WHEN contains(traj_id, 'D') THEN 'Deer' WHEN contains(traj_id, 'E') THEN 'Elk' ELSE 'Cattle' END"
add(
    "daily_distance", lambda s, d: V.trajectory_distance_treemap(herd(s, d)).select("traj_id", r("Distance", digits=3), "days", r("daily_distance", digits=3), "Species"),
    f"""WITH {_HERD}, {features("herd")}, t AS (SELECT traj_id, coalesce(sum("Distance"), 0) AS x, CAST(floor(date_diff('microsecond', min("DateTime"), max("DateTime")) / 86400e6::DOUBLE) AS INTEGER) AS days FROM feat GROUP BY traj_id)
SELECT traj_id, round(x, 3) AS "Distance", days, round(x / nullif(days, 0), 3) AS daily_distance, {_SPECIES} AS "Species" FROM t""",
)
WATER_M = 3000.0
_PAST = """past AS (SELECT lat, lon, concat('pasture ', s_suppkey % 7) AS "CowPast", CASE WHEN s_nationkey % 3 = 0 THEN 'WR' ELSE 'GR' END AS "EcoGener", CAST(s_suppkey % 2 AS DOUBLE) AS "DistEWat" FROM pois)"""
_BOXES = f"""water AS (SELECT DISTINCT lat, lon FROM past WHERE "EcoGener" = 'WR' AND "DistEWat" = 0),
boxes AS (SELECT lat - degrees({WATER_M}::DOUBLE / 6371000) AS a, lat + degrees({WATER_M}::DOUBLE / 6371000) AS c,
  lon - degrees(asin(sin({WATER_M}::DOUBLE / 6371000) / cos(radians(lat)))) AS b, lon + degrees(asin(sin({WATER_M}::DOUBLE / 6371000) / cos(radians(lat)))) AS d FROM water)"""


def _near_sql() -> str:
    return f"{_HERD}, {POIS}, {_PAST}, {_BOXES}, near AS (SELECT * FROM herd WHERE EXISTS (SELECT 1 FROM boxes WHERE herd.lat BETWEEN a AND c AND herd.lon BETWEEN b AND d))"


add("hydration_days", lambda s, d: V.hydration_days(herd(s, d), pastures(s, d), WATER_M), f'WITH {_near_sql()} SELECT traj_id, {_SPECIES} AS "Species", count(DISTINCT CAST("DateTime" AS DATE)) AS days FROM near GROUP BY traj_id')
add(
    "hydration_hours", lambda s, d: V.hydration_hours(herd(s, d), pastures(s, d), WATER_M),
    f"""WITH {_near_sql()}, t AS (SELECT {PART} AS p, {_SPECIES} AS sp FROM near) SELECT p AS "Time_Of_Day", sp AS "Species", count(*) AS n,
  list_position(['Late Night', 'Early Morning', 'Morning', 'Noon', 'Evening', 'Night'], p) AS part FROM t GROUP BY ALL""",
)
add(
    "animals_by_area", lambda s, d: V.animals_by_pasture(herd(s, d), pastures(s, d)),
    f"""WITH {_HERD}, {POIS}, {_PAST}, b AS (SELECT "CowPast", min(lat) AS a, min(lon) AS b, max(lat) AS c, max(lon) AS d FROM past GROUP BY ALL)
SELECT "CowPast", {_SPECIES} AS "Species", count(DISTINCT traj_id) AS n FROM herd JOIN b ON herd.lat BETWEEN a AND c AND herd.lon BETWEEN b AND d GROUP BY ALL""",
)
_LAND = "land AS (SELECT *, lat - floor(lat) AS \"Canopy\", abs(lon) * 10 AS \"Elev\", CAST(vertex_no AS DOUBLE) AS \"DistOPEN\" FROM habitat)"


def area_stats(s: SparkSession, d: str) -> DataFrame:
    land = habitat(s, d).withColumns({"Canopy": F.col("lat") - F.floor("lat"), "Elev": F.abs("lon") * 10, "DistOPEN": F.col("vertex_no").cast("double")})
    return V.pasture_stats(land).select("CowPast", r("mean_Canopy", digits=4), r("mean_Elev", digits=3), r("mean_DistOPEN", digits=4), "n_water")


add(
    "area_stats", area_stats,
    f"""WITH {_LAND} SELECT "CowPast", round(avg("Canopy"), 4) AS "mean_Canopy", round(avg("Elev"), 3) AS "mean_Elev", round(avg("DistOPEN"), 4) AS "mean_DistOPEN",
count(*) FILTER ("DistEWat" = 0) AS n_water FROM land WHERE "CowPast" IS NOT NULL GROUP BY ALL""",
)


# edges go the short way round, also over the 180th meridian; holes are taken off
_AREAS = """WITH v AS (SELECT *, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y, lon - lag(lon) OVER w AS d FROM habitat WINDOW w AS (PARTITION BY region_id, ring ORDER BY vertex_no, lon)),
e AS (SELECT *, radians(sum(coalesce(d + 180 - 360 * floor((d + 180) / 360) - 180, 0)) OVER w) * 6378137 AS x FROM v WINDOW w AS (PARTITION BY region_id, ring ORDER BY vertex_no, lon)),
n AS (SELECT *, first_value(y) OVER w AS y0, lead(x, 1, 0) OVER w AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM e WINDOW w AS (PARTITION BY region_id, ring ORDER BY vertex_no, lon)),
rings AS (SELECT region_id, "CowPast", ring, abs(sum(x * (y1 - y0) - x1 * (y - y0))) / 2 / 1e7::DOUBLE AS a FROM n GROUP BY ALL)
"""
add(
    "area_polygon", lambda s, d: V.pasture_areas(habitat(s, d).withColumn("name", F.col("region_id").cast("string")), "name").select("name", r("area", digits=3)),
    _AREAS + "SELECT CAST(region_id AS VARCHAR) AS name, round(sum(CASE WHEN ring > 0 THEN -a ELSE a END), 3) AS area FROM rings GROUP BY ALL",
)
add(
    "area_pasture", lambda s, d: V.pasture_areas(habitat(s, d)).select("CowPast", r("area", digits=3)),
    _AREAS + 'SELECT "CowPast", round(sum(CASE WHEN ring > 0 THEN -a ELSE a END), 3) AS area FROM rings WHERE "CowPast" IS NOT NULL GROUP BY ALL',
)
add("map_bounds", lambda s, d: V.trajectory_map(points(s, d)), f"WITH {PTS} SELECT traj_id, count(*) AS n, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts GROUP BY traj_id")
add("map_lines", lambda s, d: V.trajectory_lines(points(s, d), ["1", "7", "14"]), f"WITH {PTS} SELECT traj_id, row_number() OVER {W} AS position, lat, lon FROM pts WHERE traj_id IN ('1', '7', '14')")
add(
    "ids_by_species", lambda s, d: V.ids_by_species(animals(s, d)),
    "SELECT DISTINCT CASE \"Species\" WHEN 0 THEN 'Deer' WHEN 1 THEN 'Elk' WHEN 2 THEN 'Cattle' END AS \"Species\", traj_id FROM animal_points WHERE \"Species\" IN (0, 1, 2)",
)


# --- conversions ---------------------------------------------------------------------------------------------------
def nsew_to_degrees(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d).select("row_id", F.concat((F.col("row_id") % 90).cast("string"), F.when(F.col("row_id") % 2 == 0, ".5N").otherwise(".5S")).alias("la"), F.concat((F.col("row_id") % 200).cast("string"), F.when(F.col("row_id") % 3 == 0, ".0E").otherwise(".0W")).alias("lo"))
    return p.select("row_id", geo.nsew_to_degrees(F.col("la"), longitude=False).alias("lat"), geo.nsew_to_degrees(F.col("lo"), longitude=True).alias("lon"))


add(
    "nsew_to_degrees", nsew_to_degrees,
    """WITH v AS (SELECT event_id AS row_id, (event_id % 90)::DOUBLE + 0.5::DOUBLE AS a, (event_id % 200)::DOUBLE AS o FROM events)
SELECT row_id, CASE WHEN row_id % 2 = 0 THEN a ELSE -a END AS lat, CASE WHEN row_id % 3 = 0 THEN o WHEN o > 180 THEN 360 - o ELSE -o END AS lon FROM v""",
)
add(
    "box_by_radius", lambda s, d: pois(s, d).select("s_suppkey", *(F.round(c, 9).alias(n) for c, n in zip(geo.bounding_box_columns(F.col("lat"), F.col("lon"), 5000.0), ("a", "b", "c", "d")))),
    f"WITH {POIS}, x AS (SELECT *, degrees(5000::DOUBLE / 6371000) AS dla, degrees(asin(sin(5000::DOUBLE / 6371000) / cos(radians(lat)))) AS dlo FROM pois) SELECT s_suppkey, round(lat - dla, 9) AS a, round(lon - dlo, 9) AS b, round(lat + dla, 9) AS c, round(lon + dlo, 9) AS d FROM x",
)
