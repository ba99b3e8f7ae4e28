"""Expressions over small arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, wherever the body names it, in lambdas too.

    It is what an aggregate over nothing ends with: the value is handed on as it is, where an element of an array would be copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, body)


def lone(keys: Column) -> Column:
    """Whether no two elements are the same."""
    return F.size(F.array_distinct(keys)) == F.size(keys)
