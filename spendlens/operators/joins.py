"""Joins with dplyr's NULL rules: NA keys match each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes per value of fixed width when sizing a table for a broadcast; others
# are measured.
_VALUE_BYTES = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.FloatType: 4, T.TimestampType: 8, T.DecimalType: 16,
}


# Session setting for the size-checked broadcast limit (bytes); falls back
# to spark.sql.autoBroadcastJoinThreshold.
BROADCAST_LIMIT_CONF = "spendlens.broadcast.maxBytes"


def table_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take: exact lengths of texts and binaries,
    16 bytes more for each row and each such value. Other types of no fixed
    width are measured as JSON."""
    fixed, measured = 16, []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if type(f.dataType) in _VALUE_BYTES:
            fixed += _VALUE_BYTES[type(f.dataType)]
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            fixed += 16
            measured.append(F.octet_length(col))
        else:
            fixed += 16
            measured.append(F.octet_length(F.to_json(F.struct(col))))
    width = sum((F.coalesce(m, F.lit(0)).cast("long") for m in measured), F.lit(fixed).cast("long"))
    return df.agg(F.sum(width)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Size-checked broadcast for a *materialized* table (checkpointed or
    freshly read): measure its bytes (``table_bytes``), and mark
    it for broadcast only if that fits under ``max_bytes`` (default: the
    session's ``spendlens.broadcast.maxBytes``, else
    ``spark.sql.autoBroadcastJoinThreshold``). Otherwise the
    planner chooses (sort-merge with AQE skew handling).

    Needed because a checkpointed table keeps the size estimate of the plan
    it came from, which for an aggregate over the lines is huge even when
    the result has a few rows.
    """
    if max_bytes is None:
        conf = df.sparkSession.conf
        limit = conf.get(BROADCAST_LIMIT_CONF, None) or conf.get(
            "spark.sql.autoBroadcastJoinThreshold", "10485760"
        )
        max_bytes = _parse_bytes(limit)
    if max_bytes < 0:
        return df
    if table_bytes(df) <= max_bytes:
        return F.broadcast(df)
    return df


def _parse_bytes(text: str) -> int:
    t = text.strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if t.endswith(suffix):
            return int(float(t[: -len(suffix)]) * units[suffix])
    return int(t)


def join_nullsafe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join on ``keys`` with ``<=>`` (NULL matches NULL), keeping one
    copy of each key column, taken from the left side.

    ``<=>`` stays a hash/sort-merge join key (Spark rewrites it to
    ``coalesce(k, default), isnull(k)``), so this is no slower than ``=``.
    """
    keys = list(keys)
    r = right
    renamed = {}
    for k in keys:
        alias = f"_r_{k}"
        r = r.withColumnRenamed(k, alias)
        renamed[k] = alias
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[renamed[k]])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    if how in ("right", "right_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(left[k], r[renamed[k]]))
    elif how in ("full", "full_outer", "outer"):
        for k in keys:
            out = out.withColumn(k, F.when(left[k].isNull() & r[renamed[k]].isNotNull(), r[renamed[k]]).otherwise(left[k]))
    return out.drop(*renamed.values())


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_join(a, b)`` without ``by``: join on every shared column
    name, NULL-safe."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("natural join needs at least one shared column")
    return join_nullsafe(left, right, shared, "left")


def flag_exists(
    df: DataFrame,
    col: str,
    lookup: DataFrame,
    lookup_col: str,
    name: str,
) -> DataFrame:
    """Add boolean ``name`` = ``df[col] %in% lookup[lookup_col]`` with R's
    rules: never NULL, and a NULL value matches when the lookup holds a
    NULL.

    Non-NULL values: left join to the distinct non-NULL lookup keys (the
    planner broadcasts the keys when their size is below the broadcast
    limit, else sort-merge with AQE skew splitting). NULL values take the
    answer from a one-row scalar subquery ("does the lookup hold a NULL?"),
    and their join key is spread over the line id so NULL rows do not pile
    into one shuffle partition.
    """
    key_type = df.schema[col].dataType
    keys = (
        lookup.select(F.col(lookup_col).cast(key_type).alias("_ex_key"))
        .where(F.col("_ex_key").isNotNull())
        .distinct()
        .withColumn("_ex_null", F.lit(False))
        .withColumn("_ex_hit", F.lit(True))
    )
    lookup_has_null = lookup.select(
        F.coalesce(F.max(F.col(lookup_col).isNull()), F.lit(False))
    ).scalar()
    # Join key (value, is_null): a NULL value gets a row-dependent stand-in
    # that can never match (its is_null part is true, the lookup's false).
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast(key_type)
    probe = df.withColumn("_ex_val", F.coalesce(F.col(col), spread)).withColumn(
        "_ex_isnull", F.col(col).isNull()
    )
    cond = (probe["_ex_val"] == keys["_ex_key"]) & (probe["_ex_isnull"] == keys["_ex_null"])
    joined = probe.join(keys, cond, "left")
    return joined.withColumn(
        name,
        F.when(F.col("_ex_isnull"), lookup_has_null).otherwise(F.col("_ex_hit").isNotNull()),
    ).drop("_ex_key", "_ex_hit", "_ex_null", "_ex_val", "_ex_isnull")
