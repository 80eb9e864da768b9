"""Reusable metric expressions (Column -> Column), written once for every report.

Precision rules, so that results are exact and reproducible under any shuffle order:
money stays DECIMAL and is summed exactly; averages are taken over integers (flags,
scores, seconds) or as exact-sum / count; a ratio casts its two exact sums to double
and divides once; division by zero gives NULL (``try_divide``), never an error or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400.0
# Money aggregates use one wide decimal type: exact, and no overflow at any realistic scale.
MONEY_SUM_TYPE = "decimal(38,2)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money_sum(col: Column | str) -> Column:
    """Exact sum of a money column as DECIMAL(38,2); NULL when every input is NULL."""
    return F.sum(_c(col)).cast(MONEY_SUM_TYPE)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def exact_mean(col: Column | str) -> Column:
    """Mean of a decimal or integer column: exact sum divided once by the non-null count."""
    c = _c(col)
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def flag(condition: Column) -> Column:
    """SQL-style 0/1 flag; an unknown (NULL) condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def rate(flag_col: Column | str) -> Column:
    """Share of rows whose 0/1 flag is 1 (the denominator is every row with a flag)."""
    return F.avg(_c(flag_col).cast("int"))


def mean_days(seconds: Column | str) -> Column:
    """Average duration in days from whole seconds (exact sum, one division, then per-day)."""
    return exact_mean(seconds) / F.lit(SECONDS_PER_DAY)


def freight_burden(freight: Column | str, gmv: Column | str) -> Column:
    """freight / (merchandise GMV + freight), NULL when that outlay is zero."""
    return ratio(freight, _c(gmv) + _c(freight))


def share_of_total(value: Column | str, total: Column) -> Column:
    """value / total where total is a scalar (for instance a scalar subquery)."""
    return ratio(value, total)


def round_half_up(col: Column | str, digits: int = 2) -> Column:
    """Half-up rounding of a double at ``digits`` decimals, as a double.

    The value is first fixed to 10 decimals so the binary representation cannot decide
    ties (0.145 rounds to 0.15), then rounded as a decimal.
    """
    return F.round(_c(col).cast("decimal(38,10)"), digits).cast("double")


def pct(col: Column | str, digits: int = 2) -> Column:
    """A fraction shown as a rounded percentage (report projection only)."""
    return round_half_up(_c(col) * F.lit(100.0), digits)
