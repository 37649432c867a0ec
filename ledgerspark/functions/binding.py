"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column expression used in several places, or inside the lambda of a higher-order function, is
    evaluated at every use. As the only element of an array it becomes a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
