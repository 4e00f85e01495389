"""Distinct rows and first row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]
) -> DataFrame:
    """``distinct(df, k, .keep_all = TRUE)``: the first row (in ``order_by``
    order) of every key, all columns kept; a NULL key is one key.

    ``row_number() == 1`` is planned with a partial ``WindowGroupLimit``
    before the shuffle and a final one after it, so a hot key sends at most
    one row per map task across the network. ``dropDuplicates`` is not
    used: its surviving row is arbitrary.
    """
    cols = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn("_fk_rn", F.row_number().over(w)).where("_fk_rn = 1").drop("_fk_rn")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
