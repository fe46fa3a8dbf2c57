"""The operators over the dirty tables as they are: null and NaN coordinates, repeated and late rows, ties in time.

Features are compared with fewer digits than over clean points: a bearing between two almost equal places depends on
the last bit of the trigonometry, so it is compared where the points are a metre apart or more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import aggregates as A
from pathloom.operators import contextual as C
from pathloom.operators import filters as Fi
from pathloom.operators import interpolate as I
from pathloom.operators import kinematic as K
from pathloom.operators import stats as S
from pathloom.operators import temporal as T
from pathloom.operators.blocks import shared_folder
from pathloom.plans.catalogue import W, features
from pathloom.schema import as_trajectories, drop_columns, from_dict, from_rows, sort_by_traj_id_and_datetime
from pathloom.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BOX = (61.2, 24.6, 61.5, 25.0)
# what differs between the tables: the label, and columns that are features are left out
TABLES = {"animals": ("animal_points", "Species"), "cars": ("car_features", "vehicle_type"), "ships": ("ship_legs", "VesselTypeGroup"), "storms": ("storm_readings", None)}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = f, sql


def points(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    table, label = TABLES[which]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select("row_id", "traj_id", "DateTime", "lat", "lon", *([label] if label else []))
    return as_trajectories(df)


def pts(which: str) -> str:
    table, label = TABLES[which]
    cols = "".join(f', CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' for c in ("lat", "lon"))
    return f'pts AS (SELECT row_id, traj_id, "DateTime"{cols}{f", \"{label}\"" if label else ""} FROM {table})'


_DIGITS = {"Distance": 3, "Distance_from_start": 3, "Speed": 4, "Acceleration": 4, "Jerk": 4}
_FAR = '"Distance" >= 1'


def _kinematic(which: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        f = K.generate_kinematic_features(points(s, d, which))
        return f.select("row_id", *(F.round(c, n).alias(c) for c, n in _DIGITS.items()), F.when(F.col("Distance") >= 1, F.round("Bearing", 4)).alias("Bearing"))

    return run


for _which in TABLES:
    add(
        f"kinematic_{_which}", _kinematic(_which),
        f"WITH {pts(_which)}, {features()} SELECT row_id, " + ", ".join(f'round("{c}", {n}) AS "{c}"' for c, n in _DIGITS.items()) + f', CASE WHEN {_FAR} THEN round("Bearing", 4) END AS "Bearing" FROM feat',
    )

_A = pts("animals")
animals = lambda s, d: points(s, d, "animals")
_O = f"o AS (SELECT *, row_number() OVER {W} AS rn, row_number() OVER (PARTITION BY traj_id ORDER BY \"DateTime\" DESC, row_id) AS rz FROM pts)"
add("animals_bounding_box", lambda s, d: A.bounding_box(animals(s, d)), f"WITH {_A} SELECT min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts")
add("animals_start_location", lambda s, d: A.get_start_location(animals(s, d)), f"WITH {_A}, {_O} SELECT traj_id, lat, lon FROM o WHERE rn = 1")
add("animals_end_location", lambda s, d: A.get_end_location(animals(s, d)), f"WITH {_A}, {_O} SELECT traj_id, lat, lon FROM o WHERE rz = 1")
add("animals_duration", lambda s, d: A.get_traj_duration(animals(s, d)).select("traj_id", "seconds"), f"WITH {_A} SELECT traj_id, date_diff('microsecond', min(\"DateTime\"), max(\"DateTime\")) / 1e6::DOUBLE AS seconds FROM pts GROUP BY traj_id")
add(
    "animals_n_locations", lambda s, d: A.get_number_of_locations(animals(s, d)).withColumnRenamed("Number of Unique Coordinates", "n"),
    f"WITH {_A} SELECT traj_id, count(DISTINCT CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN (lat, lon) END) AS n FROM pts GROUP BY traj_id",
)
add("animals_distance", lambda s, d: A.distance_travelled(animals(s, d)).select("traj_id", F.round("Distance", 2).alias("Distance")), f'WITH {_A}, {features()} SELECT traj_id, round(coalesce(sum("Distance"), 0), 2) AS "Distance" FROM feat GROUP BY traj_id')
add(
    "animals_distance_by_date", lambda s, d: A.distance_travelled_by_date(animals(s, d)).select("traj_id", "Date", F.round("Distance", 2).alias("Distance")),
    f'WITH {_A}, days AS (SELECT *, CAST("DateTime" AS DATE) AS "Date" FROM pts), {features("days", "traj_id, \"Date\"")} SELECT traj_id, "Date", round(coalesce(sum("Distance"), 0), 2) AS "Distance" FROM feat GROUP BY ALL',
)
add(
    "animals_facts", lambda s, d: A.dataset_facts(animals(s, d)),
    f"""WITH {_A} SELECT count(DISTINCT traj_id) AS n_trajectories, count(*) AS n_points, min("DateTime") AS start_time, max("DateTime") AS end_time,
  min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM pts""",
)
add("animals_weekend", lambda s, d: T.generate_temporal_features(animals(s, d)).select("row_id", "Date", "Day_Of_Week", "Weekend"), f"WITH {_A} SELECT row_id, CAST(\"DateTime\" AS DATE) AS \"Date\", dayname(\"DateTime\") AS \"Day_Of_Week\", dayname(\"DateTime\") IN ('Saturday', 'Sunday') AS \"Weekend\" FROM pts")


def _filter(name: str, make: Callable[[DataFrame], DataFrame], where: str, ctes: str = "", which: str = "animals") -> None:
    add(name, lambda s, d: make(points(s, d, which)).select("row_id"), f"WITH {pts(which)}{', ' + ctes if ctes else ''} SELECT row_id FROM {'feat' if ctes else 'pts'} WHERE {where}")


_IN = f"(lat BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND lon BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE)"
add(
    "animals_dedupe", lambda s, d: Fi.remove_duplicates(animals(s, d)).select("traj_id", "DateTime", "row_id", "lat", "lon", "Species"),
    f'WITH {_A}, k AS (SELECT *, row_number() OVER (PARTITION BY traj_id, "DateTime", lat, lon ORDER BY row_id) AS rn FROM pts) SELECT traj_id, "DateTime", row_id, lat, lon, "Species" FROM k WHERE rn = 1',
)
_filter("animals_bbox_in", lambda p: Fi.filter_by_bounding_box(p, BOX), _IN)
_filter("animals_bbox_out", lambda p: Fi.filter_by_bounding_box(p, BOX, inside=False), f"NOT coalesce({_IN}, false)")
_filter("animals_max_speed", lambda p: Fi.filter_by_max_speed(p, 0.5), '"Speed" <= 0.5', features())
_filter("animals_min_speed", lambda p: Fi.filter_by_min_speed(p, 0.5), '"Speed" >= 0.5', features())
_filter("animals_max_dist_speed", lambda p: Fi.filter_by_max_distance_and_speed(p, 200, 0.5), '"Distance" <= 200 AND "Speed" <= 0.5', features())
_filter("animals_min_points", lambda p: Fi.remove_trajectories_with_less_points(p, 100), "traj_id IN (SELECT traj_id FROM pts GROUP BY traj_id HAVING count(*) >= 100)")
_filter("ships_min_dist", lambda p: Fi.filter_by_min_consecutive_distance(p, 30000), '"Distance" >= 30000', features(), "ships")
for _col, _make in (("Distance", Fi.filter_outliers_by_consecutive_distance), ("Speed", Fi.filter_outliers_by_consecutive_speed)):
    _q = f'q AS (SELECT quantile_cont("{_col}", 0.25) AS q1, quantile_cont("{_col}", 0.75) AS q3 FROM feat)'
    add(
        f"animals_iqr_{_col.lower()}", lambda s, d, make=_make: make(animals(s, d)).select("row_id"),
        f'WITH {_A}, {features()}, {_q} SELECT row_id FROM feat, q WHERE "{_col}" > q1 - 1.5 * (q3 - q1) AND "{_col}" < q3 + 1.5 * (q3 - q1)',
    )
_OVER = '(PARTITION BY traj_id ORDER BY "DateTime", row_id ROWS BETWEEN'
add(
    "cars_hampel", lambda s, d: Fi.hampel_outlier_detection(s.read.parquet(f"{d}/car_features.parquet"), "Speed").select("row_id"),
    f"""WITH v AS (SELECT *, list("Speed") FILTER ("Speed" IS NOT NULL) OVER {_OVER} 5 PRECEDING AND 4 FOLLOWING) AS a FROM car_features),
m AS (SELECT *, CASE WHEN len(a) = 10 THEN list_aggregate(a, 'median') END AS med FROM v),
s AS (SELECT *, CASE WHEN med IS NOT NULL THEN 1.4826::DOUBLE * list_aggregate(list_transform(a, lambda x: abs(x - med)), 'median') END AS sig FROM m),
f AS (SELECT *, coalesce(first_value(med IGNORE NULLS) OVER {_OVER} CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(med IGNORE NULLS) OVER {_OVER} UNBOUNDED PRECEDING AND CURRENT ROW)) AS fm,
  coalesce(first_value(sig IGNORE NULLS) OVER {_OVER} CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(sig IGNORE NULLS) OVER {_OVER} UNBOUNDED PRECEDING AND CURRENT ROW)) AS fs FROM s)
SELECT row_id FROM f WHERE NOT coalesce(abs("Speed" - fm) > 3 * fs, false)""",
)


# --- gaps, segments, statistics -------------------------------------------------------------------------------------
_RATE = 14400
_GAPS = f"""g AS (SELECT *, lag(lat) OVER {W} AS la0, lag(lon) OVER {W} AS lo0, lag("DateTime") OVER {W} AS t0 FROM pts),
h AS (SELECT *, date_diff('microsecond', t0, "DateTime") / 1e6::DOUBLE AS dt FROM g)"""
for _which in ("storms", "animals"):
    add(
        f"{_which}_interpolate", lambda s, d, which=_which: I.interpolate_position(points(s, d, which), _RATE, "linear").select("traj_id", "DateTime", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")),
        f"""WITH {pts(_which)}, {_GAPS} SELECT traj_id, "DateTime", round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts
UNION ALL SELECT traj_id, t0 + INTERVAL {_RATE} SECOND, round(la0 + (lat - la0) * ({_RATE}::DOUBLE / dt), 6), round(lo0 + (lon - lo0) * ({_RATE}::DOUBLE / dt), 6) FROM h WHERE dt > {_RATE}""",
    )
add(
    "animals_segments", lambda s, d: S.segment_traj_by_days(animals(s, d), 7, "disjoint").select("row_id", "seg_id"),
    f"""WITH {_A}, s AS (SELECT traj_id, CAST(min("DateTime") AS DATE) AS a FROM pts GROUP BY traj_id)
SELECT row_id, CAST(floor(date_diff('day', a, CAST("DateTime" AS DATE)) / 7.0::DOUBLE) AS INTEGER) + 1 AS seg_id FROM pts JOIN s USING (traj_id)""",
)
_STATS = {"50%": 'quantile_cont("{f}", 0.5)', "max": 'max("{f}")', "mean": 'avg("{f}")', "std": 'stddev_samp("{f}")'}
add(
    "animals_stats",
    lambda s, d: S.generate_kinematic_stats(animals(s, d), "Species").where(F.col("Columns").isin("Distance", "Distance_from_start", "Speed")).select("traj_id", "Columns", *(F.round(F.col(f"`{c}`"), 2).alias(c) for c in _STATS), "Species"),
    f"WITH {_A}, {features()} " + " UNION ALL ".join(
        f"SELECT traj_id, '{f}' AS \"Columns\", " + ", ".join(f'round({sql.format(f=f)}, 2) AS "{c}"' for c, sql in _STATS.items()) + ', first("Species" ORDER BY "DateTime", row_id) AS "Species" FROM feat GROUP BY traj_id'
        for f in ("Distance", "Distance_from_start", "Speed")
    ),
)
add(
    "animals_visited_location", lambda s, d: C.visited_location(animals(s, d), animals(s, d).where("lat IS NOT NULL AND lon IS NOT NULL AND Species = 1").withColumn("name", F.lit("elk")), "elk", "name").select("row_id", "Visited_elk"),
    f"""WITH {_A}, p AS (SELECT DISTINCT lat, lon FROM pts WHERE lat IS NOT NULL AND lon IS NOT NULL AND "Species" = 1)
SELECT row_id, CASE WHEN p.lat IS NULL THEN 0 ELSE 1 END AS "Visited_elk" FROM pts LEFT JOIN p ON p.lat = pts.lat AND p.lon = pts.lon""",
)
add(
    "animals_sorted", lambda s, d: sort_by_traj_id_and_datetime(animals(s, d)).select("traj_id", "DateTime", "row_id"),
    f'WITH {_A} SELECT traj_id, "DateTime", row_id FROM pts',
)
add("animals_dropped_columns", lambda s, d: drop_columns(animals(s, d), "Species"), f"WITH {_A} SELECT * EXCLUDE (\"Species\") FROM pts")


# --- sources: each table goes to a file with the published headers and comes back by its loader --------------------
def _through(table: str, rename: dict[str, str], load: Callable[[SparkSession, str], DataFrame], kind: str = "csv") -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        at = f"{shared_folder(s)}/sources-{uuid.uuid4().hex}.{kind}"
        df = s.read.parquet(f"{d}/{table}.parquet").select(*(F.col(a).alias(b) for a, b in rename.items()))
        (io.write_csv if kind == "csv" else io.write_parquet)(df, at)
        return load(s, at)

    return run


def _plain(lat: str = "lat", lon: str = "lon") -> str:
    return ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {n}" for c, n in ((lat, "lat"), (lon, "lon")))


_FOUR = {"traj_id": "traj_id", "DateTime": "DateTime", "lat": "lat", "lon": "long", "row_id": "row_id"}
_SELECT = 'SELECT traj_id, "DateTime", {0}, row_id FROM {1}'
add("source_starkey", _through("animal_points", _FOUR, io.load_starkey), _SELECT.format(_plain(), "animal_points"))
add("source_hurricanes", _through("storm_readings", _FOUR, io.load_hurricanes), _SELECT.format(_plain(), "storm_readings"))
add("source_traffic", _through("car_features", _FOUR, io.load_traffic_data), _SELECT.format(_plain(), "car_features"))
add("source_seagulls", _through("storm_readings", _FOUR, io.load_seagulls), _SELECT.format(_plain(), "storm_readings"))
add(
    "source_geo_life", _through("geolife_points", {"id": "id", "datetime": "datetime", "lat": "lat", "lon": "long", "point_id": "row_id"}, io.load_geo_life_sample),
    f'SELECT CAST(id AS VARCHAR) AS traj_id, datetime AS "DateTime", {_plain()}, point_id AS row_id FROM geolife_points',
)
add(
    "source_ships", _through("ship_legs", {"traj_id": "VesselName", "DateTime": "DateTime", "lat": "Lat", "lon": "Lon", "VesselTypeGroup": "VesselTypeGroup", "row_id": "row_id"}, io.load_ships),
    f"""SELECT traj_id, "DateTime", {_plain()}, "VesselTypeGroup", row_id FROM ship_legs
WHERE traj_id IS NOT NULL AND "DateTime" IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND "VesselTypeGroup" IS NOT NULL""",
)
_LAND = ("region_id", "CowPast", "ring", "vertex_no", "lat", "lon", "EcoGener", "DistEWat")
add("source_starkey_habitat", _through("habitat", {c: c for c in _LAND}, io.load_starkey_habitat), "SELECT " + ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' if c == "region_id" else f'"{c}"' for c in _LAND) + " FROM habitat")
add(
    "source_parquet", _through("animal_points", {"traj_id": "who", "DateTime": "when", "lat": "y", "lon": "x", "row_id": "row_id"}, lambda s, at: io.read_trajectories(s, at, "y", "x", "when", "who"), "parquet"),
    _SELECT.format(_plain(), "animal_points"),
)


def source_rows(s: SparkSession, d: str) -> DataFrame:
    """Construction from rows, with supplier as a small table of places."""
    rows = [(r["s_acctbal"] / 1000, float(r["s_suppkey"]), f"2024-01-0{r['s_suppkey'] % 9 + 1} 00:00:00", r["s_nationkey"], r["s_name"]) for r in s.read.parquet(f"{d}/supplier.parquet").collect()]
    return from_rows(s, rows, rest_of_columns=["name"]).drop("row_id")


def source_dict(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/supplier.parquet").collect()
    columns = {"y": [r["s_acctbal"] / 1000 for r in rows], "x": [float(r["s_suppkey"]) for r in rows], "at": [f"2024-01-0{r['s_suppkey'] % 9 + 1} 00:00:00" for r in rows], "who": [r["s_nationkey"] for r in rows], "name": [r["s_name"] for r in rows]}
    return from_dict(s, columns).drop("row_id")


_ROWS = "SELECT s_acctbal / 1000 AS lat, CAST(s_suppkey AS DOUBLE) AS lon, CAST('2024-01-0' || (s_suppkey % 9 + 1) || ' 00:00:00' AS TIMESTAMP) AS \"DateTime\", CAST(s_nationkey AS VARCHAR) AS traj_id, s_name AS name FROM supplier"
add("source_rows", source_rows, _ROWS)
add("source_dict", source_dict, _ROWS)
