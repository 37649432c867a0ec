"""Ratios, changes and their display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is zero."""
    return F.try_divide(part, whole) * 100


def percent_change(later: Column, earlier: Column) -> Column:
    """Relative change in percent; NULL when ``earlier`` is zero or missing."""
    return (F.try_divide(later, earlier) - 1) * 100


def is_missing(col: Column, floating: bool = True) -> Column:
    """NULL or, for floating point columns, NaN."""
    return col.isNull() | F.isnan(col) if floating else col.isNull()


def first_number(col: Column) -> Column:
    """The first number written in a formatted value, 0 when there is none."""
    digits = F.regexp_extract(F.replace(col, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def formatted(pattern: str, *values: Column) -> Column:
    """``format_string``, but NULL for a NULL value instead of a clipped "null"."""
    known = values[0].isNotNull()
    for value in values[1:]:
        known = known & value.isNotNull()
    return F.when(known, F.format_string(pattern, *values))


def format_value(value: Column, unit: Column) -> Column:
    """``$1.23B`` for amounts, ``1.23%`` for ratios, ``n/a`` for a missing value."""
    shown = F.when(unit == "%", formatted("%.2f%%", value)).otherwise(formatted("$%.2fB", value))
    return F.coalesce(shown, F.lit("n/a"))


def signed_amount(change: Column) -> Column:
    sign = F.when(change >= 0, F.lit("+")).otherwise(F.lit("-"))
    return F.coalesce(F.concat(sign, formatted("$%.2fB", F.abs(change))), F.lit("n/a"))


def signed_percent(change: Column) -> Column:
    return F.coalesce(formatted("%+.2f%%", change), F.lit("n/a"))


def signed_points(change: Column) -> Column:
    return F.coalesce(formatted("%+.2f percentage points", change), F.lit("n/a"))
