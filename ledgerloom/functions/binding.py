"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once, however often `use` names it.

    Without it Spark repeats the expression at each mention, inside a lambda even once per element.
    """
    return F.get(F.transform(F.array(value), use), 0)
