"""Sorting and dense global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.session import ensure_checkpoint_dir

# monotonically_increasing_id puts the partition index above bit 33.
_POS_BITS = 33


def asc_nulls_last(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).asc_nulls_last()


def desc_nulls_last(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).desc_nulls_last()


def _sort_cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]


def global_row_number(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_no"
) -> DataFrame:
    """Add a dense 1..n row number in ``order_by`` order without moving all
    rows into one partition (``row_number().over(Window.orderBy(...))`` does).

    1. range-partitioned sort (sampled bounds, spread over all tasks);
    2. tag each row with its partition and position, and checkpoint to the
       session's checkpoint folder so the tags stay fixed if a task is
       re-run (partition ids are not stable across re-planning);
    3. per-partition counts -> running offsets: one row per partition, so
       the broadcast of the offsets is bounded by the partition count;
    4. row number = offset of the partition + position inside it + 1.

    ``order_by`` must be a total order (add a unique tie-breaker) for the
    numbering to be deterministic.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = _sort_cols(order_by)
    tagged = (
        df.orderBy(*cols)
        .withColumn("_gr_pid", F.spark_partition_id())
        .withColumn("_gr_mono", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    offsets = (
        tagged.groupBy("_gr_pid")
        .agg(F.count(F.lit(1)).alias("_gr_cnt"))
        .withColumn(
            "_gr_off",
            F.coalesce(
                F.sum("_gr_cnt").over(
                    Window.orderBy("_gr_pid").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("_gr_pid", "_gr_off")
    )
    pos = F.col("_gr_mono") - F.shiftleft(F.col("_gr_pid").cast("long"), _POS_BITS)
    return (
        tagged.join(F.broadcast(offsets), "_gr_pid")
        .withColumn(name, F.col("_gr_off") + pos + 1)
        .drop("_gr_pid", "_gr_mono", "_gr_off")
    )


#: Bins of ``rank_by_bins`` for each factor of two between amounts.
BINS_PER_OCTAVE = 64


def rank_by_bins(df: DataFrame, value: str, ties: Sequence[str], name: str) -> DataFrame:
    """Add dense ranks 1..n, largest ``value`` first, NULL values last, equal
    values by ``ties``, without sorting the whole table or a checkpoint.

    Rows fall into bins that ascend with the value: equal steps of log(1 +
    |value|), some 8,000 bins over all amounts below 1e18. A histogram (one
    row per bin) gives each bin's offset; the rows are sorted only within
    their bin. ``df`` should be an aggregate: both uses share its exchange.
    All rows of one value are one bin's."""
    x = F.col(value).cast("double")
    bin_no = F.coalesce(F.round(-F.signum(x) * F.log2(F.abs(x) + 1) * BINS_PER_OCTAVE).cast("int"), F.lit((1 << 31) - 1))
    binned = df.withColumn("_rb_bin", bin_no)
    before = Window.orderBy("_rb_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy("_rb_bin").agg(F.count(F.lit(1)).alias("_rb_n"))
    offsets = counts.select("_rb_bin", F.coalesce(F.sum("_rb_n").over(before), F.lit(0)).alias("_rb_off"))
    inside = Window.partitionBy("_rb_bin").orderBy(F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties])
    # the histogram has at most one row per bin: bounded by the bins
    ranked = binned.withColumn("_rb_in", F.row_number().over(inside)).join(F.broadcast(offsets), "_rb_bin")
    return ranked.withColumn(name, F.col("_rb_off") + F.col("_rb_in")).drop("_rb_bin", "_rb_in", "_rb_off")


def global_cumsum(
    df: DataFrame, order_by: Sequence[str | Column], weight: str, name: str
) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over all rows *before* this one in
    ``order_by`` order (exclusive running total), distributed like
    ``global_row_number``: range-partitioned sort, checkpoint, per-partition
    totals -> offsets (one row per partition, broadcast), plus a running
    sum inside each partition (a window whose group is one sorted range
    partition, so it is bounded by the partition size)."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = _sort_cols(order_by)
    tagged = df.orderBy(*cols).withColumn("_gc_pid", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.partitionBy("_gc_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_gc_pid")
        .agg(F.sum(weight).alias("_gc_tot"))
        .withColumn(
            "_gc_off",
            F.coalesce(
                F.sum("_gc_tot").over(Window.orderBy("_gc_pid").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_gc_pid", "_gc_off")
    )
    return (
        tagged.withColumn("_gc_in", F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .join(F.broadcast(offsets), "_gc_pid")
        .withColumn(name, F.col("_gc_off") + F.col("_gc_in"))
        .drop("_gc_pid", "_gc_off", "_gc_in")
    )


def positions_from_groups(df: DataFrame, id_col: str, group_bits: int, name: str) -> DataFrame:
    """Dense 1..n position in ``id_col`` order for ids built as
    ``group * 2^group_bits + index`` where ``index`` runs densely from
    ``first`` (0 or 1) inside each group: position = rows of all earlier
    groups + index offset. Only the per-group counts (one row per group:
    per file, or per order) are sorted; the rows themselves are not, and
    they meet their group's offset in a join on the group key."""
    grp = F.shiftright(F.col(id_col), group_bits)
    idx = F.col(id_col).bitwiseAND(F.lit((1 << group_bits) - 1))
    keyed = df.withColumn("_pg_g", grp).withColumn("_pg_i", idx)
    groups = keyed.groupBy("_pg_g").agg(F.count(F.lit(1)).alias("_pg_n"), F.min("_pg_i").alias("_pg_first"), F.max("_pg_i").alias("_pg_last"))
    # a gap (rows filtered out before) would give wrong positions
    dense = F.col("_pg_last") - F.col("_pg_first") + 1 == F.col("_pg_n")
    first = F.when(dense, F.col("_pg_first")).otherwise(F.raise_error(F.lit("ids are not dense within a group: number the rows instead")).cast("long"))
    # (one row per group; combined map-side)
    groups = groups.withColumn("_pg_first", first)
    offsets = global_cumsum(groups, ["_pg_g"], "_pg_n", "_pg_off").select("_pg_g", "_pg_off", "_pg_first")
    # few groups (files): broadcast after an exact size check; many groups
    # (orders): a join on the group key
    from spendlens.operators.joins import broadcast_if_small

    return (
        keyed.join(broadcast_if_small(offsets), "_pg_g")
        .withColumn(name, F.col("_pg_off") + (F.col("_pg_i") - F.col("_pg_first")) + 1)
        .drop("_pg_g", "_pg_i", "_pg_off", "_pg_first")
    )


def sort_report(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Order a finished report-sized table (tens of rows) in one task:
    a global ``orderBy`` would first run a sampling job for range bounds.
    ``coalesce(1)`` merges the report's last (tiny) stage into one task
    without another shuffle. Plain column names sort ascending with NULLs
    last, like R's arrange. Not for line-level data; use ``orderBy``."""
    return df.coalesce(1).sortWithinPartitions(*_sort_cols(order_by))
