"""PO spend bins (two-way flag and Micro / Small / Large).

Plan: scan (status / amount / PO filters pushed to the reader) -> partial
sum per PO -> one shuffle on ``po_no`` -> final sum -> label -> partial
count/sum per bin -> tiny shuffle -> percent over the three-row result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.classify import spend_bin
from spendlens.functions.ordering import level_rank
from spendlens.labels import BIN_LEVELS
from spendlens.operators.filters import amount_nonneg, covered, not_null, status_filter
from spendlens.operators.ordering import sort_report
from spendlens.operators.totals import pct_of_total
from spendlens.params import DEFAULT_PARAMS, SpendParams


def po_totals_for_bins(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Per-PO totals over lines with amount >= 0, a PO number and an allowed
    status (the bin reports' own filter set)."""
    # The status test goes first: with the positional rule, positions are
    # those of the rows the filter receives (all lines).
    clean = (
        lines.transform(covered, p)
        .transform(status_filter, p)
        .transform(amount_nonneg)
        .transform(not_null, "po_no")
    )
    return clean.groupBy("po_no").agg(F.sum("sum_amount").alias("po_total_amt"))


def spend_bin_flag(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Count and spend of POs split by ``total >= large_min``. The flag keeps
    the reference's (misleading) name ``under_equal_50k``."""
    po = po_totals_for_bins(lines, p)
    return (
        po.withColumn("under_equal_50k", F.col("po_total_amt") >= p.large_min)
        .groupBy("under_equal_50k")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.sum("po_total_amt").cast("double").alias("spend"),
        )
    )


def spend_bins(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Micro / Small / Large: count, % of count, spend, % of spend, in level
    order."""
    po = po_totals_for_bins(lines, p)
    out = (
        po.withColumn("bin_level", spend_bin("po_total_amt", p))
        .groupBy("bin_level")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("po_total_amt").alias("spend_dec"))
        .transform(pct_of_total, "cnt", "pct_cnt")
        .transform(pct_of_total, "spend_dec", "pct_spend")
        .withColumn("spend", F.col("spend_dec").cast("double"))
        .withColumn("_rank", level_rank("bin_level", BIN_LEVELS))
        .transform(sort_report, ["_rank"])
    )
    return out.select("bin_level", "cnt", "pct_cnt", "spend", "pct_spend")
