"""Dates and calendar months."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_dates(col: Column, fmt: str = "iso") -> Column:
    """Day-first or ISO text to a UTC timestamp; anything unreadable becomes null."""
    text = F.trim(col)
    iso = text.try_cast("timestamp")
    if fmt != "dmy":
        return iso
    day_first = [F.try_to_timestamp(text, F.lit(p)) for p in ("d/M/yyyy", "d/M/yyyy H:mm:ss")]
    return F.coalesce(day_first[0], iso, day_first[1])


def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def period_str(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def month_index(col: Column) -> Column:
    """Months since year 0, so that calendar distance is plain subtraction."""
    return F.year(col) * 12 + F.month(col)


def month_diff(a: Column, b: Column) -> Column:
    return month_index(a) - month_index(b)
