"""Time helpers that keep the column's own timestamp type (zoned or not)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_to(df: DataFrame, name: str, unit: str = "day") -> Column:
    """date_trunc that hands back the type it was given."""
    return F.date_trunc(unit, F.col(name)).cast(df.schema[name].dataType)


def shift(column: Column, interval: str) -> Column:
    return column + F.expr(f"INTERVAL {interval}")


def micros(column: Column) -> Column:
    """Microseconds since the epoch, for exact step arithmetic."""
    return F.unix_micros(column.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def norm_epoch(value: Column) -> Column:
    """Epoch milliseconds, or microseconds from 1e14 upwards, as a timestamp cut to milliseconds."""
    v = value.cast("long")
    return F.timestamp_millis(F.when(v >= F.lit(100_000_000_000_000), F.floor(v / 1000)).otherwise(v).cast("long"))


def parse_seen_date(value: Column, fallback: Column) -> Column:
    """Two accepted layouts, otherwise the fallback moment."""
    return F.coalesce(
        F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss'Z'")),
        F.try_to_timestamp(value, F.lit("yyyyMMddHHmmss")),
        fallback,
    )
