"""Zone-free time arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(name: str) -> Column:
    """Microseconds from 1970 to a wall-clock time, independent of the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, cast(`{name}` AS timestamp_ntz))")


def seconds_between(a: str, b: str) -> Column:
    """Seconds from column (or SQL expression) ``a`` to ``b`` as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b}) / 1000000D")
