"""The trajectory point table: columns, errors and construction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

LAT, LON, TIME, TRAJ, ROW = "lat", "lon", "DateTime", "traj_id", "row_id"
MANDATORY = (LAT, LON, TIME, TRAJ)
FEATURES = ("Distance", "Distance_from_start", "Speed", "Acceleration", "Jerk", "Bearing", "Bearing_Rate", "Rate_of_bearing_rate")


# The names of the errors that follow (all but the base), which callers know.
class TrajectoryError(ValueError):
    """Base of the library's errors."""


class MissingColumnsException(TrajectoryError):
    """A needed column is absent."""


class AmbiguousColumnException(TrajectoryError):
    """Two columns claim one role."""


class NoHeadersException(TrajectoryError):
    """Rows without column names."""


class DataTypeMismatchException(TrajectoryError):
    """A column cannot be read as its type."""


class DateTimeFormatInvalid(TrajectoryError):
    """A time cannot be read."""


class MandatoryColumnException(TrajectoryError):
    """A mandatory column would be lost."""


class MissingTrajIDException(TrajectoryError):
    """No trajectory has the id."""


class NotAllowedException(TrajectoryError):
    """The operation is not allowed."""


def need(df: DataFrame, *columns: str) -> None:
    """Raises before anything runs if a column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MissingColumnsException(f"missing columns: {', '.join(absent)}; present: {', '.join(df.columns)}")


def as_trajectories(df: DataFrame, latitude: str = LAT, longitude: str = LON, datetime: str = TIME, traj_id: str = TRAJ) -> DataFrame:
    """The point table with canonical names and types, other columns untouched, ``row_id`` added if absent.

    Headers match exactly. Coordinates become doubles with NaN as null, times ``timestamp_ntz`` (microseconds),
    ids strings. What cannot be cast raises when the plan runs (ANSI casts), never turns into null.
    """
    roles = {latitude: LAT, longitude: LON, datetime: TIME, traj_id: TRAJ}
    need(df, *roles)
    for have, want in roles.items():
        if have != want and want in df.columns and want not in roles:
            raise AmbiguousColumnException(f"both {have} and {want} would be {want}")
    typed = {LAT: "double", LON: "double", TIME: "timestamp_ntz", TRAJ: "string"}
    cols = []
    for c in df.columns:
        role = roles.get(c)
        if role is None:
            cols.append(F.col(f"`{c}`"))
        elif role in (LAT, LON):
            v = F.col(f"`{c}`").cast("double")
            cols.append(F.when(~F.isnan(v), v).alias(role))
        else:
            cols.append(F.col(f"`{c}`").cast(typed[role]).alias(role))
    out = df.select(*cols)
    return out if ROW in out.columns else out.withColumn(ROW, F.monotonically_increasing_id())


def from_dict(spark: SparkSession, data: Mapping[str, Sequence[Any]]) -> DataFrame:
    """A mapping of columns; the first four are latitude, longitude, time and id by position."""
    names = list(data)
    if len(names) < 4:
        raise MissingColumnsException("a mapping needs at least four columns")
    rows = list(zip(*data.values()))
    df = _rows(spark, rows, [*MANDATORY, *names[4:]])
    return as_trajectories(df)


def from_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], latitude: str = LAT, longitude: str = LON, datetime: str = TIME, traj_id: str = TRAJ, rest_of_columns: Sequence[str] | None = None) -> DataFrame:
    """A list of rows or a two-dimensional array: latitude, longitude, time, id and then ``rest_of_columns``."""
    rows = [tuple(r) for r in (rows.tolist() if hasattr(rows, "tolist") else rows)]
    names = [latitude, longitude, datetime, traj_id, *(rest_of_columns or [])]
    if rows and len(rows[0]) != len(names):
        raise NoHeadersException(f"rows have {len(rows[0])} values, headers name {len(names)}")
    return as_trajectories(_rows(spark, rows, names), latitude, longitude, datetime, traj_id)


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    if not rows:
        return spark.createDataFrame([], ", ".join(f"`{n}` {'double' if i < 2 else 'string'}" for i, n in enumerate(names)))
    numbered = [(i, float(r[0]) if r[0] is not None else None, float(r[1]) if r[1] is not None else None, str(r[2]), str(r[3]), *r[4:]) for i, r in enumerate(rows)]
    head = [ROW, *names]
    return spark.createDataFrame(numbered, head).select(*[f"`{n}`" for n in names], ROW)


def track(*more: str) -> WindowSpec:
    """The one ordered window that point features share (one exchange, one sort)."""
    return Window.partitionBy(TRAJ, *more).orderBy(TIME, ROW)


def ordered(df: DataFrame) -> DataFrame:
    """``df`` with the tie-break column that the ordered window needs."""
    need(df, *MANDATORY)
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def sort_by_traj_id_and_datetime(df: DataFrame, ascending: bool = True) -> DataFrame:
    need(df, TRAJ, TIME)
    keys = [TRAJ, TIME, *([ROW] if ROW in df.columns else [])]
    return df.orderBy(*keys, ascending=ascending)


def to_numpy(df: DataFrame):
    """The whole table as a numpy array on the driver (for small results)."""
    return df.toPandas().to_numpy()


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drops columns that are not mandatory."""
    lost = [c for c in columns if c in MANDATORY]
    if lost:
        raise MandatoryColumnException(f"cannot drop {', '.join(lost)}")
    need(df, *columns)
    return df.drop(*columns)
