"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strict_sum(col) -> Column:
    """R ``sum`` without ``na.rm``: NULL as soon as one input is NULL.

    Built from two counts and a sum, all of which combine map-side, so it
    keeps the partial/final hash aggregation of a plain ``sum``.
    """
    c = _c(col)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def first_value_by(value, order) -> Column:
    """Value of ``value`` on the row with the smallest ``order`` in the group
    (rows with a NULL ``order`` are ignored)."""
    return F.min_by(_c(value), _c(order))
