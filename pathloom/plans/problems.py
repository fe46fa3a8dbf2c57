"""The queries of the data-pipeline problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.regrid import regular_grid
from pathloom.operators.rolling import trailing_totals
from pathloom.operators.spatial import near_and_inside
from pathloom.operators.spikes import implausible
from pathloom.operators.stops import stops_and_trips
from pathloom.operators.timestamps import normalise_timestamps
from pathloom.operators.tree import tree_profile

CAR_BOUNDS = {"Speed": (0.0, 100.0), "Acceleration": (-30.0, 30.0), "lat": (-90.0, 90.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_and_inside(table(spark, sf_dir, "geolife_points"), table(spark, sf_dir, "habitat"))


def p2_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(table(spark, sf_dir, "car_features"), CAR_BOUNDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_spikes(spark, sf_dir).select("row_id", "field")


def p3_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_timestamps(table(spark, sf_dir, "seagull_fixes"), table(spark, sf_dir, "stations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(utc_us / 1000000 AS decimal(18, 6)))")
    return p3_utc(spark, sf_dir).where(F.col("utc_us").isNotNull()).select("fix_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("utc"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops_and_trips(table(spark, sf_dir, "animal_points")).select("traj_id", "kind", "start_at", "end_at")


def p4_stops_and_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops_and_trips(table(spark, sf_dir, "animal_points"))


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_totals(table(spark, sf_dir, "ship_legs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda n: F.round(f"total_{n}").cast("long").alias(f"metres_{n}")
    return p5_rolling(spark, sf_dir).select("traj_id", F.date_format("day", "yyyy-MM-dd").alias("day"), whole(7), whole(30))


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "storm_readings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_grid(spark, sf_dir).where("missing").select("traj_id", "slot")


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_profile(table(spark, sf_dir, "animal_points")).withColumn("distance_m", F.round("distance_m", 2))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tree_profile(table(spark, sf_dir, "animal_points"), distance=False)
    rows = counts.agg(F.sum("n_rows")).first()[0] or 0  # over the states, one row for each key and chunk
    return counts.where(F.col("traj_id").isNotNull() & (F.col("n_rows") * 100 >= rows)).select("traj_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p2_found,
        p2_spikes,
        p3_found,
        p3_utc,
        p4_found,
        p4_stops_and_trips,
        p5_found,
        p5_rolling,
        p6_found,
        p6_grid,
        p7_found,
        p7_profile,
    )
}
_DAILY = """
WITH once AS (
  SELECT DISTINCT traj_id, DateTime, CASE WHEN isnan(Distance) THEN NULL ELSE Distance END AS v
  FROM ship_legs WHERE traj_id IS NOT NULL AND DateTime IS NOT NULL),
daily AS (SELECT traj_id, CAST(DateTime AS DATE) AS d, coalesce(sum(v), 0) AS x FROM once GROUP BY ALL),
span AS (SELECT traj_id, min(d) AS a, max(d) AS z FROM daily GROUP BY traj_id),
days AS (SELECT traj_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
full_days AS (SELECT days.traj_id, day, coalesce(x, 0) AS x FROM days LEFT JOIN daily ON daily.traj_id = days.traj_id AND d = day),
rolled AS (
  SELECT traj_id, day,
    sum(x) OVER (PARTITION BY traj_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7,
    sum(x) OVER (PARTITION BY traj_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30
  FROM full_days)
"""

_NEAR_AND_INSIDE = """
WITH c AS (
  SELECT point_id AS pid, id, lat, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS lon FROM geolife_points
  WHERE point_id IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360),
pairs AS (
  SELECT a.pid AS a_id, b.pid AS b_id,
    power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h
  FROM c a JOIN c b ON b.lat BETWEEN a.lat - 0.0003 AND a.lat + 0.0003 WHERE a.pid < b.pid AND a.id <> b.id),
v AS (SELECT region_id, ring, vertex_no, lat AS y, lon, lon - lag(lon) OVER w AS d FROM habitat WHERE lat IS NOT NULL AND lon IS NOT NULL WINDOW w AS (PARTITION BY region_id, ring ORDER BY vertex_no)),
x AS (SELECT *, first_value(lon) OVER w + sum(coalesce(d + 180 - 360 * floor((d + 180) / 360) - 180, 0)) OVER w AS x FROM v WINDOW w AS (PARTITION BY region_id, ring ORDER BY vertex_no)),
e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM x WINDOW w AS (PARTITION BY region_id, ring ORDER BY vertex_no)),
turned AS (SELECT pid, lat, lon + s AS lon, s FROM c, (VALUES (-360), (0), (360)) t(s)),
hit AS (
  SELECT region_id, ring, pid, s FROM turned JOIN e ON lat BETWEEN least(y, y1) AND greatest(y, y1)
  WHERE (y > lat) <> (y1 > lat) AND turned.lon < (x1 - x) * (lat - y) / (y1 - y) + x GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT 'near' AS relation, a_id, b_id FROM pairs WHERE 2000 * 6371 * atan2(sqrt(h), sqrt(1 - h)) <= 30
UNION ALL SELECT DISTINCT 'inside', region_id, pid FROM hit o WHERE ring = 0 AND NOT EXISTS (SELECT 1 FROM hit i WHERE i.region_id = o.region_id AND i.pid = o.pid AND i.ring > 0)"""


def _spikes_sql() -> str:
    def at(k: int) -> str:
        return "v" if k == 0 else f"l{-k}" if k < 0 else f"r{k}"

    ways = []
    for width in (1, 2, 3):
        for j in range(width):  # the reading is the j-th of a stretch of that width
            p, q, own = at(-j - 1), at(width - j), [at(k - j) for k in range(width)]
            ways.append(" AND ".join([f"abs({p} - {q}) <= lim", *(f"abs({m} - {x}) > lim" for m in own for x in (p, q))]))
    lags = ", ".join(f"lag(v, {k}) OVER w AS l{k}, lead(v, {k}) OVER w AS r{k}" for k in (1, 2, 3))
    each = " UNION ALL ".join(f"SELECT row_id, traj_id, DateTime, Speed AS still, lat AS place, '{f}' AS field, {f} AS v, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM one WHERE {f} IS NOT NULL AND NOT isnan({f})" for f, (lo, hi) in CAR_BOUNDS.items())
    return f"""
WITH one AS (SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM car_features WHERE traj_id IS NOT NULL GROUP BY ALL),
u AS ({each}),
s AS (SELECT *, {lags} FROM u WINDOW w AS (PARTITION BY traj_id, field ORDER BY DateTime, row_id)),
m AS (SELECT traj_id, field, 15 * median(abs(v - l1)) AS lim FROM s GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN v = l1 THEN 0 ELSE 1 END) OVER (PARTITION BY traj_id, field ORDER BY DateTime, row_id) AS run FROM s),
k AS (SELECT traj_id, field, run, count(*) >= 8 AND NOT (bool_and(still = 0 OR still IS NULL) AND coalesce(bool_or(still = 0), false) AND coalesce(min(place) = max(place), false)) AS stuck FROM g GROUP BY ALL)
SELECT row_id, field FROM g JOIN k USING (traj_id, field, run) JOIN m USING (traj_id, field)
WHERE v < lo OR v > hi OR stuck OR coalesce({') OR coalesce('.join(f'({w}), false' for w in ways)})"""


_PROFILE = """
WITH p AS (SELECT traj_id, DateTime, row_id, CASE WHEN isnan(lat) THEN NULL ELSE lat END AS lat, CASE WHEN isnan(lon) THEN NULL ELSE lon END AS lon FROM animal_points),
n AS (SELECT traj_id, count(*) AS n_rows FROM p GROUP BY traj_id),
q AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WHERE lat IS NOT NULL AND lon IS NOT NULL AND DateTime IS NOT NULL WINDOW w AS (PARTITION BY traj_id ORDER BY DateTime, row_id)),
d AS (SELECT *, power(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin(radians(lon - lo) / 2), 2) AS h FROM q),
s AS (SELECT traj_id, count(*) AS n_points, epoch_us(min(DateTime)) AS first_us, epoch_us(max(DateTime)) AS last_us, coalesce(sum(2000 * 6371 * atan2(sqrt(h), sqrt(1 - h))), 0) AS m FROM d GROUP BY traj_id)
SELECT n.traj_id, n_rows, coalesce(n_points, 0) AS n_points, first_us, last_us, (last_us - first_us) / 1e6::DOUBLE AS duration_s, round(coalesce(m, 0), 2) AS distance_m
FROM n LEFT JOIN s ON n.traj_id IS NOT DISTINCT FROM s.traj_id"""

ORACLES: dict[str, str] = {
    "p1_found": _NEAR_AND_INSIDE,
    "p2_found": _spikes_sql(),
    "p7_profile": _PROFILE,
    "p5_found": _DAILY + "SELECT traj_id, strftime(day, '%Y-%m-%d') AS day, CAST(t7 AS BIGINT) AS metres_7, CAST(t30 AS BIGINT) AS metres_30 FROM rolled",
    "p5_rolling": _DAILY + "SELECT traj_id, day, t7 AS total_7, t7 / 7 AS mean_7, t30 AS total_30, t30 / 30 AS mean_30 FROM rolled",
    "p6_found": """
WITH slots AS (
  SELECT DISTINCT traj_id, time_bucket(INTERVAL 6 HOUR, DateTime, TIMESTAMP '1970-01-01') AS s FROM storm_readings
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND traj_id IS NOT NULL AND DateTime IS NOT NULL),
grid AS (SELECT traj_id, unnest(generate_series(min(s), max(s), INTERVAL 6 HOUR)) AS s FROM slots GROUP BY traj_id)
SELECT traj_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS slot FROM grid ANTI JOIN slots USING (traj_id, s)""",
    "p7_found": "SELECT traj_id FROM animal_points WHERE traj_id IS NOT NULL GROUP BY traj_id HAVING count(*) * 100 >= (SELECT count(*) FROM animal_points)",
}
