"""Time expressions: epoch hours, the three kinds of day, cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_hour(ts: Column) -> Column:
    """Whole hours since 1970 of a timestamp (session zone UTC)."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("long")


def hour_to_timestamp(hour: Column) -> Column:
    return F.timestamp_seconds(hour * 3600)


def hour_of_day(hour: Column) -> Column:
    return F.pmod(hour, F.lit(24)).cast("int")


def day_of_hour(hour: Column, shift: int = 0) -> Column:
    """Calendar date of an epoch hour moved by ``shift`` hours.

    ``shift=0`` is the UTC day, ``shift=-12`` the day anchored at a 12 UTC emission,
    ``shift=11`` the rain-gauge day that ends at 12 UTC.
    """
    return F.date_from_unix_date(F.floor((hour + shift) / 24).cast("int"))


def anchored_date(ts: Column, anchor_hour: int) -> Column:
    return F.to_date(ts - F.expr(f"INTERVAL {int(anchor_hour)} HOURS"))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """North and east components of a wind named by where it comes from."""
    angle = F.radians(direction)
    return -F.cos(angle) * speed, -F.sin(angle) * speed


def instant(date_text: Column, hour_text: Column) -> Column:
    """UTC timestamp of an ISO date text (its first ten characters) and ``HH:MM``."""
    return F.try_to_timestamp(
        F.concat(F.substring(date_text, 1, 10), F.lit(" "), hour_text), F.lit("yyyy-MM-dd H:mm")
    )
