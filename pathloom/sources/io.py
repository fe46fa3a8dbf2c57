"""Reading and writing point tables.

Loaders take a path: a file, a folder or a glob of CSV (or Parquet) in any file system that Spark reads. A given schema
spares the pass that infers one; trajectory ids are text in either case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from pathloom.schema import as_trajectories


@dataclass(frozen=True)
class Dataset:
    """Headers of a published data set, and whether rows with any missing value are dropped on loading."""

    latitude: str
    longitude: str
    datetime: str
    traj_id: str
    drop_missing: bool = False


# The headers of the published data sets.
DATASETS = {
    "hurricanes": Dataset("lat", "long", "DateTime", "traj_id"),
    "traffic": Dataset("lat", "long", "DateTime", "traj_id"),
    "geo_life": Dataset("lat", "long", "datetime", "id"),
    "seagulls": Dataset("lat", "long", "DateTime", "traj_id"),
    "ships": Dataset("Lat", "Lon", "DateTime", "VesselName", drop_missing=True),
    "starkey": Dataset("lat", "long", "DateTime", "traj_id"),
}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A plain table from CSV with a header, or from Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).option("preferDate", False).csv(path)


def _as_text(df: DataFrame, spark: SparkSession, path: str, column: str) -> DataFrame:
    """A CSV table again, with a column as it is written: an id such as 910313E37 is no number."""
    fields = [StructField(f.name, StringType() if f.name == column else f.dataType) for f in df.schema]
    return spark.read.option("header", True).schema(StructType(fields)).csv(path)


def read_trajectories(spark: SparkSession, path: str, latitude: str = "lat", longitude: str = "lon", datetime: str = "DateTime", traj_id: str = "traj_id", schema: str | None = None, drop_missing: bool = False) -> DataFrame:
    df = read_table(spark, path, schema)
    if not schema and not path.rstrip("/").endswith(".parquet") and traj_id in df.columns and dict(df.dtypes)[traj_id] != "string":
        df = _as_text(df, spark, path, traj_id)
    return as_trajectories(df.na.drop("any") if drop_missing else df, latitude, longitude, datetime, traj_id)


def load(spark: SparkSession, name: str, path: str, schema: str | None = None) -> DataFrame:
    """One of ``DATASETS`` from its file."""
    d = DATASETS[name]
    return read_trajectories(spark, path, d.latitude, d.longitude, d.datetime, d.traj_id, schema, d.drop_missing)


def load_hurricanes(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "hurricanes", path)


def load_traffic_data(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "traffic", path)


def load_geo_life_sample(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "geo_life", path)


def load_seagulls(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "seagulls", path)


def load_ships(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "ships", path)


def load_starkey(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "starkey", path)


def load_starkey_habitat(spark: SparkSession, path: str) -> DataFrame:
    """A plain table, not trajectories."""
    return read_table(spark, path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; times keep their microseconds (Spark's default format has milliseconds)."""
    micro = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", micro).option("timestampFormat", micro + "XXX").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
