"""Event-time helpers that never consult the session time zone.

Driver tables carry TIMESTAMP_NTZ (wall clock, no zone). Casting it to TIMESTAMP would read
it in the session zone (and shift around DST); these helpers read it as UTC instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _is_ntz(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.TimestampNTZType)


def epoch_micros(df: DataFrame, c: str) -> Column:
    """Microseconds since the epoch; NTZ values are read as UTC."""
    if _is_ntz(df, c):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{c}`)")
    return F.unix_micros(F.col(c).cast("timestamp"))


def utc_instant(df: DataFrame, c: str) -> Column:
    """A TIMESTAMP (instant) for watermarks and windows; NTZ values are read as UTC."""
    if _is_ntz(df, c):
        return F.timestamp_micros(epoch_micros(df, c))
    return F.col(c).cast("timestamp")


def to_ntz(instant: Column) -> Column:
    """Instant -> UTC wall clock as TIMESTAMP_NTZ (for zone-independent output)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH_NTZ))
