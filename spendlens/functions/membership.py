"""Membership in a literal list with R ``%in%`` rules: never NULL.

``x %in% list`` is FALSE (not NA) for a NULL ``x`` when the list holds no
NULL, so exclusion with ``!x %in% list`` keeps NULL rows. Spark's ``isin``
returns NULL for a NULL input, hence the ``coalesce``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_member(col, values: Iterable) -> Column:
    vals = list(values)
    if not vals:
        return F.lit(False)
    return F.coalesce(_c(col).isin(vals), F.lit(False))


def not_member(col, values: Iterable) -> Column:
    return ~is_member(col, values)
