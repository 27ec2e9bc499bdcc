"""Time columns as integers, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(name: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def seconds(name: str) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz)) / 1000000) as bigint)")
