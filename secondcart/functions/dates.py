"""Day arithmetic on zone-less timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    return F.to_date(ts)


def calendar_day_gap(later: Column, earlier: Column) -> Column:
    """Midnights crossed between two instants: 23:59 to 00:01 is one day."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def elapsed_days_floor(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods between two instants, rounded down also below zero.

    Promised at midnight and delivered at 13:00 of that day is -1, where a calendar
    difference would say 0.
    """
    gap = calendar_day_gap(later, earlier)
    overshoot = earlier + F.make_dt_interval(gap) > later
    return gap - overshoot.cast("int")
