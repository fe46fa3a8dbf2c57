"""A chained form of the operators: ``Trajectories(df).filter_by_date(...).create_speed_column().df``.

Every operator that takes and returns a DataFrame is a method; results that are not tables come back as they are.
Most operators only add to the plan; those that need counts, samples or blocks first (README) run jobs when called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pathloom import schema
from pathloom.operators import aggregates, contextual, filters, interpolate, kinematic, linked, stats, temporal, views
from pathloom.operators import regrid, rolling, spikes, stops, timestamps, tree

_HOMES = (kinematic, linked, temporal, filters, interpolate, stats, contextual, aggregates, views, regrid, rolling, spikes, stops, timestamps, tree, schema)


def operators() -> dict[str, Callable]:
    """Public operators by name."""
    found: dict[str, Callable] = {}
    for m in _HOMES:
        for name, f in vars(m).items():
            if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == m.__name__ and not isinstance(f, type):
                found.setdefault(name, f)
    return found


class Trajectories:
    def __init__(self, df: DataFrame, latitude: str = "lat", longitude: str = "lon", datetime: str = "DateTime", traj_id: str = "traj_id"):
        self.df = schema.as_trajectories(df, latitude, longitude, datetime, traj_id)

    @classmethod
    def _of(cls, df: DataFrame) -> Trajectories:
        out = cls.__new__(cls)
        out.df = df
        return out

    def __getattr__(self, name: str):
        f = operators().get(name)
        if f is None:
            raise AttributeError(name)

        def call(*args, **kwargs):
            out = f(self.df, *args, **kwargs)
            return Trajectories._of(out) if isinstance(out, DataFrame) else out

        return call

    @property
    def latitude(self) -> DataFrame:
        return self.df.select(schema.LAT)

    @property
    def longitude(self) -> DataFrame:
        return self.df.select(schema.LON)

    @property
    def datetime(self) -> DataFrame:
        return self.df.select(schema.TIME)

    @property
    def traj_id(self) -> DataFrame:
        return self.df.select(schema.TRAJ)

    def set_default_index(self) -> Trajectories:
        """Trajectory and time first, then the other columns; the tie-break column is added if absent."""
        df = schema.ordered(self.df)
        keys = [schema.TRAJ, schema.TIME]
        return Trajectories._of(df.select(*keys, *(f"`{c}`" for c in df.columns if c not in keys)))

    def __str__(self) -> str:
        f = aggregates.dataset_facts(self.df).first()
        return (
            f"trajectories: {f['n_trajectories']}\npoints: {f['n_points']}\ntime range: {f['start_time']} to {f['end_time']}\n"
            f"bounding box: ({f['min_lat']}, {f['min_lon']}, {f['max_lat']}, {f['max_lon']})"
        )
