"""A name for an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it: a lambda over an array of one. Without it a
    value that is used k times in each of n nested expressions is written out, and computed, k ** n times."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
