"""Time arithmetic on microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp (with or without zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down also when negative."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY_US)).cast("long")


def day_cell(ts: Column | str, width_us: int = DAY_US) -> Column:
    """Number of the fixed-width time cell that holds a timestamp."""
    return F.floor(micros(ts) / F.lit(width_us)).cast("long")
