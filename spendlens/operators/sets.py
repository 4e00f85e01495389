"""Row appends (``bind_rows``) and distinct unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame) -> DataFrame:
    """Append rows, columns matched by name, missing columns NULL."""
    if not dfs:
        raise ValueError("a union needs at least one table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()
