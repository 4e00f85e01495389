"""Group totals: sums per key, totals attached to lines, percent of total,
grand-total row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.aggregates import strict_sum
from spendlens.labels import TOTAL_LABEL
from spendlens.operators.joins import broadcast_if_small, join_nullsafe
from spendlens.session import ensure_checkpoint_dir


def group_sum(
    df: DataFrame, keys: Sequence[str], value: str, name: str, strict: bool = False
) -> DataFrame:
    """Sum of ``value`` per key (hash aggregate, combined map-side).
    ``strict=True`` gives R's NA-propagating ``sum``."""
    agg = strict_sum(value) if strict else F.sum(value)
    return df.groupBy(*keys).agg(agg.alias(name))


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row count per key (``n()``: rows with NULLs count)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


#: Rows of one key that a task may hold when group totals are attached.
HOT_ROWS = 2_000_000
#: Hash buckets in which rows are counted first to find the keys above that.
HOT_BUCKETS = 1 << 16


def hot_key_totals(df: DataFrame, keys: Sequence[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Sum (``name``) and rows (``_hot_n``) of the keys with more than
    ``hot_rows`` rows, exactly, or None. Rows are counted by hash bucket (a
    row per bucket), then by key in the full buckets alone; both combine
    map-side and read only the keys and the value. Above some 30 billion rows
    the limit grows to four times a bucket's mean, so that few buckets are full."""
    ensure_checkpoint_dir(df.sparkSession)
    bucketed = df.select(*keys, F.col(value).alias("_hot_v"), F.pmod(F.xxhash64(*keys), F.lit(HOT_BUCKETS)).cast("int").alias("_hot_b"))
    counts = bucketed.groupBy("_hot_b").count().collect()
    limit = max(hot_rows, 4 * sum(r[1] for r in counts) // HOT_BUCKETS)
    full = [r[0] for r in counts if r[1] > limit]
    if not full:
        return None
    per_key = bucketed.where(F.col("_hot_b").isin(full)).groupBy(*keys).agg(F.sum("_hot_v").alias(name), F.count(F.lit(1)).alias("_hot_n"))
    hot = per_key.where(F.col("_hot_n") > hot_rows).checkpoint(eager=True)
    return None if hot.isEmpty() else hot


def attach_group_total(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    strategy: str = "measured",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row gets the sum of ``value`` over its key group (NULL key is
    one group).

    ``strategy="measured"`` counts first (``hot_key_totals``, a narrow pass).
    Keys of at most ``hot_rows`` rows get their sum from one window over the
    key, so the rows are read once and meet in one exchange. The totals of
    hotter keys come from that count by a join, and their rows are spread
    over parts of that size in the same exchange.
    ``strategy="join"`` aggregates and joins the totals back on the key: two
    reads of the rows; AQE's skew join can split a hot key.
    ``strategy="window"`` is the window alone, for keys known to be even.
    """
    if strategy == "window":
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys)))
    if strategy == "join":
        totals = df.groupBy(*keys).agg(F.sum(value).alias(name))
        return join_nullsafe(df, totals, keys, "left")
    hot = hot_key_totals(df, keys, value, "_hot_sum", hot_rows)
    if hot is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys)))
    known = join_nullsafe(df, broadcast_if_small(hot), keys, "left")
    parts = F.ceil(F.col("_hot_n") / hot_rows)
    spread = F.when(F.col("_hot_n").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), parts))
    own = F.sum(value).over(Window.partitionBy(*keys, "_hot_part"))
    out = known.withColumn("_hot_part", spread).withColumn("_hot_own", own)
    total = F.when(F.col("_hot_n").isNotNull(), F.col("_hot_sum")).otherwise(F.col("_hot_own"))
    return out.withColumn(name, total).drop("_hot_part", "_hot_own", "_hot_sum", "_hot_n")


def pct_of_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """``100 * x / sum(x)`` over the whole table, in double arithmetic.
    The window has no partition key, so use it on aggregated report tables
    only, never on line-level data."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(name, F.col(value).cast("double") / total.cast("double") * 100)


def with_totals_row(
    df: DataFrame,
    label_col: str,
    numeric_cols: Sequence[str],
    label: str = TOTAL_LABEL,
    flag_col: str = "is_total",
) -> DataFrame:
    """Append a grand-total row (``adorn_totals``): numeric columns summed,
    ``label_col`` set to ``label``. ``label_col`` must be unique per row (a
    finished report). ``flag_col`` tells the total row apart from a row
    whose label is NULL, and sorts it last.
    """
    out = df.rollup(label_col).agg(
        *[F.sum(c).alias(c) for c in numeric_cols],
        F.grouping(label_col).cast("boolean").alias(flag_col),
    )
    return out.withColumn(
        label_col,
        F.when(F.col(flag_col), F.lit(label)).otherwise(F.col(label_col)),
    )
