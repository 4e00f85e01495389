"""Vendor totals for one business unit.

One ``groupBy(vendor)`` computes both the spend and the distinct PO count
(Spark plans a single distinct aggregate as a two-level aggregation keyed
by (vendor, po_no) first, so a vendor with many lines is combined
map-side). Ranks come from a histogram of the totals and a sort within its
bins (``rank_by_bins``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.filters import covered, drop_members, equals
from spendlens.operators.ordering import rank_by_bins
from spendlens.params import DEFAULT_PARAMS, SpendParams


def distinct_count_per_key(df: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Number of distinct ``counted`` values per ``key`` with NULL counted
    as one value (``distinct(a, b) %>% count(b)``): ``count_distinct``
    skips NULL, so one is added when the group has a NULL."""
    return df.groupBy(key).agg(
        (F.count_distinct(counted) + F.max(F.col(counted).isNull().cast("int"))).alias(name)
    )


def vendor_lines(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Lines of the vendor report: one unit, excluded buyers removed (a NULL
    buyer is kept)."""
    return lines.transform(covered, p).transform(drop_members, "buyer", p.vendor_excluded_buyers).transform(
        equals, "unit", p.vendor_unit
    )


def vendor_totals_unranked(lines: DataFrame) -> DataFrame:
    return lines.groupBy("vendor").agg(
        (F.count_distinct("po_no") + F.max(F.col("po_no").isNull().cast("int"))).alias("num_pos"),
        F.sum("sum_amount").alias("vendor_total_dec"),
    ).select(
        "vendor",
        F.col("num_pos").cast("long").alias("num_pos"),
        F.col("vendor_total_dec").cast("double").alias("vendor_total"),
        (F.col("vendor_total_dec").cast("double") / F.lit(1_000_000.0)).alias("vendor_total_mm"),
    )


def vendor_totals(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Vendor -> distinct PO count, total, total in millions, rank (1 =
    largest total; ties by vendor name; NULL totals last)."""
    t = vendor_totals_unranked(vendor_lines(lines, p))
    return rank_by_bins(t, "vendor_total", ["vendor"], "vendor_rank")


def top_vendors(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Vendors whose total reaches ``vendor_min_total_mm`` million, with
    their rank in the full table: all vendors with larger totals reach it
    too, so only those that do are ranked."""
    t = vendor_totals_unranked(vendor_lines(lines, p)).where(F.col("vendor_total_mm") >= p.vendor_min_total_mm)
    return rank_by_bins(t, "vendor_total", ["vendor"], "vendor_rank")
