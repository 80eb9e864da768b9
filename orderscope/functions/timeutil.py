"""Timestamp helpers for zone-less (TIMESTAMP_NTZ) columns.

All arithmetic is wall-clock arithmetic on the calendar fields, independent of the
session time zone. (Spark's ``timestamp_diff`` and ``date_format`` read an NTZ value
through the session zone, which shifts values that fall in a daylight-saving gap.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _micros_of_day(ts: Column) -> Column:
    whole = (F.hour(ts) * 3_600 + F.minute(ts) * 60).cast("long") * F.lit(MICROS_PER_SECOND)
    seconds = F.date_part(F.lit("SECOND"), ts)  # decimal(8,6): seconds with microseconds
    return whole + (seconds * F.lit(MICROS_PER_SECOND)).cast("long")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Exact wall-clock microseconds from start to end."""
    s, e = _c(start), _c(end)
    days = F.datediff(F.to_date(e), F.to_date(s)).cast("long")
    return days * F.lit(MICROS_PER_DAY) + (_micros_of_day(e) - _micros_of_day(s))


def _truncate(micros: Column, unit: int) -> Column:
    """Whole units, truncated toward zero (as TIMESTAMPDIFF does)."""
    return F.call_function("div", micros, F.lit(unit).cast("long"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end (truncated), as a long."""
    return _truncate(micros_between(start, end), MICROS_PER_SECOND)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Whole hours from start to end, truncated toward zero."""
    return _truncate(micros_between(start, end), MICROS_PER_HOUR)


def calendar_days_between(earlier: Column | str, later: Column | str) -> Column:
    """Difference of the two calendar dates in days (time of day ignored)."""
    return F.datediff(F.to_date(_c(later)), F.to_date(_c(earlier)))


def month_key(ts: Column | str) -> Column:
    """'yyyy-MM' month label."""
    return F.substring(_c(ts).cast("string"), 1, 7)


def iso_seconds(ts: Column | str) -> Column:
    """ISO-8601 text with second precision, e.g. 2018-08-29T15:00:37."""
    return F.translate(F.substring(_c(ts).cast("string"), 1, 19), " ", "T")


def month_start(month: str) -> str:
    """'2017-01' -> '2017-01-01 00:00:00'."""
    return f"{month}-01 00:00:00"


def next_month_start(month: str) -> str:
    """'2018-08' -> '2018-09-01 00:00:00' (exclusive upper bound of a month window)."""
    year, mon = (int(x) for x in month.split("-"))
    year, mon = (year + 1, 1) if mon == 12 else (year, mon + 1)
    return f"{year:04d}-{mon:02d}-01 00:00:00"
