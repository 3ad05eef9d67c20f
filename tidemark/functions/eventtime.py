"""Event time as TIMESTAMP, and epoch seconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_MICROSECOND = "interval '0.000001' second"


def event_time(df: DataFrame, name: str) -> Column:
    """The event-time column ``name`` of ``df`` as TIMESTAMP or, without a zone, TIMESTAMP_NTZ.

    Both can be windowed. Wall-clock times stay what they are here: turning each
    of them into a TIMESTAMP costs more than the whole windowing.
    """
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(kind, T.DateType):
        return value.cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        return F.timestamp_seconds(value)
    raise TypeError(f"Column {name!r} of type {kind.simpleString()} cannot be an event time.")


def as_timestamp(df: DataFrame, name: str) -> Column:
    """The event-time column ``name`` of ``df`` as TIMESTAMP, which a watermark needs.

    TIMESTAMP_NTZ and DATE are read as UTC, numbers as epoch seconds.
    """
    value = event_time(df, name)
    if has_zone(df, name):
        return value
    return F.timestamp_micros(_micros_since_epoch(value))


def has_zone(df: DataFrame, name: str) -> bool:
    """Whether :func:`event_time` gives a TIMESTAMP."""
    return not isinstance(df.schema[name].dataType, (T.TimestampNTZType, T.DateType))


def epoch_seconds(timestamp: Column, zoned: bool = True) -> Column:
    """Seconds since 1970-01-01T00:00:00Z, as DOUBLE; wall-clock time counts as UTC."""
    micros = F.unix_micros(timestamp) if zoned else _micros_since_epoch(timestamp)
    return micros / F.lit(1_000_000.0)


def _micros_since_epoch(wall_clock: Column) -> Column:
    # A cast to TIMESTAMP would go through the session zone and lose the hours
    # around daylight-saving changes; a difference of wall-clock times does not.
    return F.call_function("div", wall_clock - F.expr(_EPOCH), F.expr(_MICROSECOND))


def tumbling(timestamp: Column, size_seconds: int) -> Column:
    """Left-closed, right-open, epoch-aligned window of ``size_seconds``."""
    return F.window(timestamp, f"{int(size_seconds)} seconds")


# Fixed value: where Spark notes the watermark delay of a column.
_WATERMARK = "spark.watermarkDelayMs"


def watermarked(df: DataFrame, name: str, delay_seconds: int) -> DataFrame:
    """``df`` with a watermark on column ``name``, unless it brings one."""
    if _WATERMARK in df.schema[name].metadata:
        return df
    return df.withWatermark(name, f"{delay_seconds} seconds")
