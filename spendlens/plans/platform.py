"""Sourcing-platform reports.

The base table has one row per PO: the PO total (all its lines) and the
attributes of its first line, plus the platform and buyer type derived from
them. Plan:

  lines --partial agg--> shuffle on po_no --final agg--> per-PO row
        (sum of amounts + min(struct(line_id, attrs)) = first line)
  per-PO row --left join--> distinct bid-log ids (broadcast when the size
        check allows, else sort-merge with NULL ids spread out)
  -> platform / buyer type expressions (codegen)

Everything downstream is a small aggregate of this table; callers that run
several reports should ``persist()`` it once.

Only the first line of a PO decides its platform, so the bid-log test runs
on per-PO rows, not on lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens import labels as L
from spendlens.functions.classify import buyer_type, platform, size_label
from spendlens.functions.dates import month_label
from spendlens.functions.membership import is_member, not_member
from spendlens.operators.filters import covered, month_in
from spendlens.operators.joins import flag_exists
from spendlens.operators.sets import union_distinct
from spendlens.params import DEFAULT_PARAMS, SpendParams

FIRST_LINE_ATTRS = ["buyer", "unit", "origin", "req_id", "vendor", "quote_link", "po_date"]


def po_rows(lines: DataFrame) -> DataFrame:
    """One row per PO (NULL PO is one PO): ``amt`` = sum of its line
    amounts (NULLs skipped), first-line attributes, ``first_line_id``."""
    first = F.min(F.struct("line_id", *FIRST_LINE_ATTRS)).alias("first")
    per_po = lines.groupBy("po_no").agg(F.sum("sum_amount").alias("amt"), first)
    return per_po.select(
        "po_no",
        "amt",
        *[F.col(f"first.{c}").alias(c) for c in FIRST_LINE_ATTRS],
        F.col("first.line_id").alias("first_line_id"),
    )


def all_bids(*bid_logs: DataFrame) -> DataFrame:
    """Bid-log sheets appended and made distinct (ids only)."""
    return union_distinct(*[b.select("req_id") for b in bid_logs])


def po_platform(lines: DataFrame, bids: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Per-PO platform table (``amt`` kept as exact decimal)."""
    per_po = po_rows(covered(lines, p))
    flagged = flag_exists(per_po, "req_id", bids, "req_id", "in_bid_log")
    return flagged.withColumn(
        "platform", platform("origin", "in_bid_log", "quote_link", p)
    ).withColumn("buyer_type", buyer_type("origin", "buyer", p))


def _out(df: DataFrame) -> DataFrame:
    """Money columns to double for output."""
    return df.withColumn("amt", F.col("amt").cast("double"))


def po_platform_report(lines: DataFrame, bids: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    t = po_platform(lines, bids, p)
    return _out(t).select("po_no", "amt", *FIRST_LINE_ATTRS, "platform")


def _count_spend(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("qty_of_pos"),
        F.sum("amt").cast("double").alias("total_spend"),
    )


def platform_summary(po: DataFrame) -> DataFrame:
    """Platform -> PO count, spend."""
    return _count_spend(po, "platform")


def uncategorized_size(po: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Uncategorized POs split at ``size_split`` -> PO count."""
    return (
        po.where(F.col("platform") == L.PLATFORM_NONE)
        .withColumn("size", size_label("amt", p))
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("qty_of_pos"))
    )


def buyer_type_summary(po: DataFrame) -> DataFrame:
    """Buyer type -> PO count, spend (NULL type and the text "NA" apart)."""
    return _count_spend(po, "buyer_type")


def vendors_by_platform(po: DataFrame) -> DataFrame:
    """Platform -> number of vendors whose first PO (in line order) is on
    that platform, and the platform's PO count. Platforms with no first
    vendor PO are absent (the reference joins from the vendor side).

    One chain over the per-PO table: ``groupBy(vendor, platform)`` (PO count
    and first line id, combined map-side, so a dominant vendor is reduced
    before the shuffle); then a window over ``vendor`` marks the platform
    holding the vendor's first PO (at most one row per platform per vendor,
    so every window group is small); then ``groupBy(platform)``.
    """
    vp = po.groupBy("vendor", "platform").agg(
        F.count(F.lit(1)).alias("n_pos"), F.min("first_line_id").alias("first_id")
    )
    is_first = F.col("first_id") == F.min("first_id").over(Window.partitionBy("vendor"))
    out = (
        vp.withColumn("_is_first", is_first)
        .groupBy("platform")
        .agg(
            F.count(F.when(F.col("_is_first"), 1)).alias("qty_of_vendors"),
            F.sum("n_pos").alias("qty_of_pos"),
        )
    )
    return out.where(F.col("qty_of_vendors") > 0).select("platform", "qty_of_vendors", "qty_of_pos")


def month_summary(po: DataFrame, key: str, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Calendar month (any year) x ``key`` -> PO count, spend, for the
    months in ``p.report_months``; one aggregate for all months."""
    return (
        po.transform(month_in, "po_date", p.report_months)
        .withColumn("month", month_label("po_date"))
        .groupBy("month", key)
        .agg(
            F.count(F.lit(1)).alias("qty_of_pos"),
            F.sum("amt").cast("double").alias("total_spend"),
        )
    )


def one_month(po: DataFrame, key: str, month: int) -> DataFrame:
    """One calendar month (any year): ``key`` -> PO count, spend."""
    return _count_spend(po.transform(month_in, "po_date", [month]), key)


def po_extract(po: DataFrame) -> DataFrame:
    """Slim per-PO extract."""
    return _out(po).select("platform", "po_no", "amt", "buyer", "origin", "unit", "vendor")


def platform_under_limit(po: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Platform summary of POs with total <= ``small_po_max`` that are not
    blacklisted (a NULL PO number is not in the blacklist)."""
    small = po.where(F.col("amt") <= p.small_po_max).where(not_member("po_no", p.po_blacklist))
    return _count_spend(small, "platform")


def buyer_subsets(po: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """The sourcing-exec subset (``buyer %in% list``) and its complement
    (``!buyer %in% list``, NULL buyers included), as one tagged table: they
    partition the POs, so one projection tags every row."""
    return po.select(
        "po_no",
        "buyer",
        "platform",
        F.when(is_member("buyer", p.type_sourcing_execs), F.lit("sourcing_exec"))
        .otherwise(F.lit("other"))
        .alias("subset"),
    )


def buyer_list_subsets(po: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Non-inventory and inventory buyer subsets, tagged. A PO whose buyer is
    on both lists appears in both subsets; one pass emits its tags."""
    tags = F.array(
        F.when(is_member("buyer", p.type_non_inventory), F.lit("non_inventory")),
        F.when(is_member("buyer", p.type_inventory), F.lit("inventory")),
    )
    return po.select(
        "po_no", "buyer", "platform", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("subset")
    )
