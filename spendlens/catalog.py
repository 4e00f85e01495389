"""Registered queries: one per operator / report key of the inventory.

Each entry takes ``(spark, sf_dir)``, builds the PO lines and bid logs from
the test tables (``sources.tpch_binding``) and returns the result
DataFrame. Money leaves as ``double``, counts as ``long``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.classify import buyer_class, platform
from spendlens.functions.conditional import if_else
from spendlens.functions.dates import fiscal_year_start, in_period
from spendlens.functions.ordering import level_rank
from spendlens.functions.text import money_text, starts_with_na
from spendlens import labels as L
from spendlens.labels import BIN_LEVELS
from spendlens.operators import dedupe, filters, joins, ordering, sets, totals
from spendlens.params import DEFAULT_PARAMS as P
from spendlens.plans import clean_lines, platform as plat, spend_bins, unit_summary, vendors
from spendlens.schema import canonical_to_sheet
from spendlens.session import ensure_checkpoint_dir
from spendlens.sinks.csv import read_csv_set, write_csv, write_csv_numbered
from spendlens.sources import files, tpch_binding as tb

Query = Callable[[SparkSession, str], DataFrame]

LINE_OUT = [
    "po_no", "unit", "status", "sum_amount", "po_date", "buyer", "level_1", "level_2",
    "origin", "req_id", "bid_category", "vendor", "quote_link",
]


# Analyzed plans of the shared inputs, per (application, folder). A
# DataFrame is an immutable plan, not data: reusing it only saves the
# driver from re-analyzing the binding; every query still reads the files.
_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def _memo(kind: str, spark: SparkSession, sf: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, kind)
    df = _PLANS.get(key)
    if df is None or df.sparkSession is not spark:
        df = build()
        _PLANS[key] = df
    return df


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("lines", spark, sf, lambda: tb.po_lines(spark, sf))


def bids(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(
        "bids", spark, sf, lambda: plat.all_bids(tb.bid_log_2017(spark, sf), tb.bid_log_2018(spark, sf))
    )


def po_table(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("po", spark, sf, lambda: plat.po_platform(lines(spark, sf), bids(spark, sf), P))


def line_out(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c).cast("double").alias(c) if c == "sum_amount" else F.col(c) for c in LINE_OUT]
    )


def _status_clean(spark, sf):
    return lines(spark, sf).transform(filters.status_filter, P)


def _vendor_totals_all(spark, sf) -> DataFrame:
    return vendors.vendor_totals_unranked(lines(spark, sf)).select("vendor", "vendor_total")


# ---------------------------------------------------------------- sources
def _scratch(spark, name) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_src_po_lines(spark, sf):
    """The lines written as sheet exports (title lines, columns in another
    order by file, comments that span lines) and read from them. The files
    are as many as a million lines each need at least, and 4 at least."""
    path = _scratch(spark, "export")
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    tb.write_po_export(spark, sf, path, files=max(4, n // 1_000_000))
    return line_out(files.read_po_lines_csv(spark, path))


def q_src_bids(spark, sf):
    """Both bid logs written as header-less exports and read from them."""
    out = []
    for sheet, bid_log in (("2017", tb.bid_log_2017(spark, sf)), ("2018", tb.bid_log_2018(spark, sf))):
        path = _scratch(spark, "bids")
        tb.write_bid_export(bid_log, path)
        out.append(files.read_bid_log(spark, path).select(F.lit(sheet).alias("sheet"), "req_id"))
    return sets.union_all(*out)


# ---------------------------------------------------------------- sinks
def q_sink_csv(spark, sf):
    """The vendor totals written as a CSV set and read from it, as text."""
    path = _scratch(spark, "csv")
    write_csv(vendors.vendor_totals(lines(spark, sf), P), path, order_by=["vendor_rank"])
    return read_csv_set(spark, path).drop("_line")


def q_sink_csv_numbered(spark, sf):
    """The spend bins written as a numbered CSV set and read from it, with
    their types (doubles to ten decimals; the file has 15 digits)."""
    path = _scratch(spark, "csv")
    report = spend_bins.spend_bins(lines(spark, sf), P)
    write_csv_numbered(report, path, [level_rank("bin_level", BIN_LEVELS).asc_nulls_last()])
    back = read_csv_set(spark, path)
    typed = [F.round(F.col(c).cast(t), 10).alias(c) if t == "double" else F.col(c).cast(t).alias(c) for c, t in report.dtypes]
    return back.select(F.col("row_name").cast("long").alias("row_name"), *typed)


# ---------------------------------------------------------------- projections / filters
def q_op_rename(spark, sf):
    return line_out(lines(spark, sf)).withColumnsRenamed(canonical_to_sheet("working"))


def q_op_status_exclude(spark, sf):
    return line_out(_status_clean(spark, sf))


def q_op_status_cycle(spark, sf):
    kept = filters.exclude_statuses_positional(
        lines(spark, sf), P.excluded_statuses, ["line_id"], group_bits=tb.LINE_RANK_BITS
    )
    return line_out(kept)


def q_op_amount_nonneg(spark, sf):
    return line_out(lines(spark, sf).transform(filters.amount_nonneg))


def with_nulls(df: DataFrame) -> DataFrame:
    """PO numbers divisible by 7, and vendors and units whose names end in 3,
    set to NULL, for the queries that show what NULL keys do."""
    ends = lambda c: F.when(~F.col(c).endswith("3"), F.col(c)).alias(c)
    return df.withColumns({"po_no": F.when(F.col("po_no") % 7 != 0, F.col("po_no")), "vendor": ends("vendor"), "unit": ends("unit")})


def q_op_has_po(spark, sf):
    return line_out(with_nulls(lines(spark, sf)).transform(filters.not_null, "po_no"))


def q_op_date_range(spark, sf):
    a = P.period_a
    return line_out(lines(spark, sf).transform(filters.date_range, "po_date", a.start, a.end))


def q_op_month_filter(spark, sf):
    return line_out(lines(spark, sf).transform(filters.month_in, "po_date", P.report_months[:1]))


def q_op_member_include(spark, sf):
    """POs of the non-inventory and of the inventory buyers, a filter each."""
    po = po_table(spark, sf).select("po_no", "buyer", "platform")
    kept = [po.transform(filters.keep_members, "buyer", buyers).withColumn("subset", F.lit(name)) for name, buyers in (("non_inventory", P.type_non_inventory), ("inventory", P.type_inventory))]
    return sets.union_all(*kept)


def q_op_member_exclude(spark, sf):
    return line_out(lines(spark, sf).transform(filters.drop_members, "buyer", P.vendor_excluded_buyers))


def q_op_eq_filter(spark, sf):
    return line_out(lines(spark, sf).transform(filters.equals, "unit", P.vendor_unit))


def q_op_complement(spark, sf):
    """POs of the sourcing executives and of all others, NULL buyers included."""
    po = po_table(spark, sf).select("po_no", "buyer", "platform")
    execs, others = filters.split_members(po, "buyer", P.type_sourcing_execs)
    return sets.union_all(execs.withColumn("subset", F.lit("sourcing_exec")), others.withColumn("subset", F.lit("other")))


# ---------------------------------------------------------------- joins
def q_op_natural_left_join(spark, sf):
    """YTD spend per unit natural-left-joined with period-A spend per unit.
    Both sides come from one per-unit aggregate, checkpointed once (one
    pass over the lines; the checkpoint is a row per unit)."""
    a = P.period_a
    in_a = in_period("po_date", a.start, a.end)
    ensure_checkpoint_dir(spark)
    per_unit = (
        with_nulls(_status_clean(spark, sf))
        .groupBy("unit")
        .agg(
            F.sum("sum_amount").alias("year_spend"),
            F.sum(F.when(in_a, F.col("sum_amount"))).alias("period_a_spend"),
            F.count(F.when(in_a, 1)).alias("_n_a"),
        )
        .checkpoint(eager=True)
    )
    ytd = per_unit.select("unit", "year_spend")
    april = per_unit.where(F.col("_n_a") > 0).select("unit", "period_a_spend")
    j = joins.natural_left_join(ytd, april)
    return j.select(
        "unit",
        F.col("year_spend").cast("double").alias("year_spend"),
        F.col("period_a_spend").cast("double").alias("period_a_spend"),
    )


def q_op_left_join_nullsafe(spark, sf):
    """Distinct-PO count per vendor left-joined (NULL-safe) with spend per
    vendor; both sides from one per-vendor aggregate, checkpointed once."""
    ensure_checkpoint_dir(spark)
    per_vendor = vendors.vendor_totals_unranked(with_nulls(lines(spark, sf))).checkpoint(eager=True)
    counts = per_vendor.select("vendor", "num_pos")
    tot = per_vendor.select("vendor", "vendor_total")
    return joins.join_nullsafe(counts, tot, ["vendor"], "left").select("vendor", "num_pos", "vendor_total")


def q_op_attach_po_total(spark, sf):
    j = totals.attach_group_total(lines(spark, sf), ["po_no"], "sum_amount", "amt")
    return j.select(
        "po_no",
        F.col("sum_amount").cast("double").alias("sum_amount"),
        F.col("amt").cast("double").alias("amt"),
    )


def q_op_attach_unit_po_total(spark, sf):
    j = clean_lines.unit_po_total_lines(lines(spark, sf), P)
    return j.select(
        "po_no",
        "unit",
        F.col("sum_amount").cast("double").alias("sum_amount"),
        F.col("po_total_amount").cast("double").alias("po_total_amount"),
    )


def q_op_exists_nullsafe(spark, sf):
    j = joins.flag_exists(lines(spark, sf), "req_id", bids(spark, sf), "req_id", "in_bid_log")
    return j.select("po_no", "req_id", "in_bid_log")


def q_op_explicit_taxonomy(spark, sf):
    ln = lines(spark, sf)
    ensure_checkpoint_dir(spark)
    # one row per level_2, materialized once, broadcast after a size check
    taxonomy = joins.broadcast_if_small(clean_lines.taxonomy_parent_counts(ln).checkpoint(eager=True))
    return clean_lines.with_explicit_taxonomy(ln, taxonomy, P).select(
        "po_no", "level_1", "level_2", "explicit_taxonomy_2"
    )


# ---------------------------------------------------------------- aggregates
def q_op_group_sum(spark, sf):
    t = totals.group_sum(lines(spark, sf), ["unit"], "sum_amount", "spend")
    return t.select("unit", F.col("spend").cast("double").alias("spend"))


def q_op_group_sum_strict(spark, sf):
    t = totals.group_sum(lines(spark, sf), ["po_no"], "sum_amount", "po_total_strict", strict=True)
    return t.select("po_no", F.col("po_total_strict").cast("double").alias("po_total_strict"))


def q_op_group_count(spark, sf):
    return totals.group_count(lines(spark, sf), ["unit"], "n_lines")


def q_rpt_unit_po_total(spark, sf):
    clean = lines(spark, sf).transform(filters.exclude_statuses, P.excluded_statuses).transform(filters.amount_nonneg)
    t = totals.group_sum(clean, ["unit", "po_no"], "sum_amount", "po_total_amount")
    return t.select("unit", "po_no", F.col("po_total_amount").cast("double").alias("po_total_amount"))


def q_op_distinct_count_per_key(spark, sf):
    t = vendors.distinct_count_per_key(with_nulls(lines(spark, sf)), "vendor", "po_no", "num_pos")
    return t.select("vendor", F.col("num_pos").cast("long").alias("num_pos"))


def q_op_first_attributed_count(spark, sf):
    first = dedupe.first_per_key(_status_clean(spark, sf), ["po_no"], ["line_id"])
    return totals.group_count(first, ["unit"], "po_count")


def q_op_as_of_dates(spark, sf):
    return clean_lines.as_of_dates(lines(spark, sf), P)


def q_op_totals_row(spark, sf):
    per_unit = lines(spark, sf).groupBy("unit").agg(
        F.sum("sum_amount").alias("spend"), F.count(F.lit(1)).alias("n_lines")
    )
    t = totals.with_totals_row(per_unit, "unit", ["spend", "n_lines"])
    return t.select("unit", F.col("spend").cast("double").alias("spend"), "n_lines", "is_total")


def q_op_pct_of_total(spark, sf):
    per_unit = totals.group_sum(_status_clean(spark, sf), ["unit"], "sum_amount", "spend")
    t = totals.pct_of_total(per_unit, "spend", "pct_spend")
    return t.select("unit", F.col("spend").cast("double").alias("spend"), "pct_spend")


# ---------------------------------------------------------------- distinct / first row
def q_op_distinct_rows(spark, sf):
    j = totals.attach_group_total(lines(spark, sf), ["po_no"], "sum_amount", "amt")
    proj = j.select(
        "po_no", F.col("amt").cast("double").alias("amt"), "buyer", "unit", "origin",
        "req_id", "vendor", "quote_link", "po_date",
    )
    return dedupe.distinct_rows(proj)


def q_op_distinct_cols(spark, sf):
    return dedupe.distinct_cols(lines(spark, sf), "level_1", "level_2")


def q_op_first_per_key(spark, sf):
    return line_out(dedupe.first_per_key(with_nulls(lines(spark, sf)), ["po_no"], ["line_id"]))


# ---------------------------------------------------------------- sorts
def q_op_sort_asc(spark, sf):
    t = _vendor_totals_all(spark, sf)
    return ordering.global_row_number(
        t, [F.col("vendor_total").asc_nulls_last(), F.col("vendor").asc_nulls_last()], "pos"
    )


def q_op_sort_desc(spark, sf):
    t = _vendor_totals_all(spark, sf)
    return ordering.global_row_number(
        t, [F.col("vendor_total").desc_nulls_last(), F.col("vendor").asc_nulls_last()], "pos"
    )


# ---------------------------------------------------------------- sets
def q_op_union_all(spark, sf):
    return sets.union_all(tb.bid_log_2017(spark, sf), tb.bid_log_2018(spark, sf))


def q_op_union_distinct(spark, sf):
    return sets.union_distinct(tb.bid_log_2017(spark, sf), tb.bid_log_2018(spark, sf))


# ---------------------------------------------------------------- scalar functions
def q_op_if_else(spark, sf):
    ln = lines(spark, sf)
    return ln.select(
        "po_no", "origin",
        if_else(F.col("origin") == P.swc_origin, L.PLATFORM_SWC, "Other").alias("swc_flag"),
    )


def q_op_buyer_class(spark, sf):
    return lines(spark, sf).select("po_no", "buyer", buyer_class("buyer", P).alias("buyer_classification"))


def q_op_fill_zero(spark, sf):
    return unit_summary._zero_filled_decimal(lines(spark, sf), P).select(
        "unit",
        *[
            F.col(c).cast("double").alias(c) if c in unit_summary.SPEND_COLS else F.col(c)
            for c in unit_summary.REPORT_COLS[1:]
        ],
    )


def q_op_fill_label(spark, sf):
    j = joins.flag_exists(lines(spark, sf), "req_id", bids(spark, sf), "req_id", "in_bid_log")
    raw = if_else(
        F.col("origin") == P.swc_origin,
        L.PLATFORM_SWC,
        if_else(
            F.col("in_bid_log"),
            L.PLATFORM_BID_LOG,
            if_else(starts_with_na("quote_link", P.quote_prefix), L.PLATFORM_QUOTE, L.PLATFORM_NONE),
        ),
    )
    return j.select(
        "po_no", raw.alias("platform_raw"), platform("origin", "in_bid_log", "quote_link", P).alias("platform")
    )


def q_op_prefix_match(spark, sf):
    return lines(spark, sf).select("po_no", "quote_link", starts_with_na("quote_link", P.quote_prefix).alias("starts_h"))


def q_op_format_money(spark, sf):
    per_unit = totals.group_sum(_status_clean(spark, sf), ["unit"], "sum_amount", "spend")
    return per_unit.select("unit", money_text("spend").alias("spend_text"))


def q_op_round_half_even(spark, sf):
    per_unit = totals.group_sum(_status_clean(spark, sf), ["unit"], "sum_amount", "spend")
    return per_unit.select("unit", F.bround("spend", 0).cast("long").alias("spend_rounded"))


def q_op_period_flags(spark, sf):
    ln = lines(spark, sf)
    as_of = clean_lines._as_of(ln, P)
    return clean_lines.period_flags(ln, as_of).select("po_no", "po_date", "in_last_1_month", "in_last_2_months")


def q_op_fiscal_year_start(spark, sf):
    return lines(spark, sf).select(
        "po_no", "po_date", fiscal_year_start("po_date", P.fiscal_year_start_month).alias("fiscal_year_start")
    )


# ---------------------------------------------------------------- reports
def q_rpt_clean_po_lines(spark, sf):
    return clean_lines.clean_po_lines_report(lines(spark, sf), P)


def q_rpt_taxonomy_duplicates(spark, sf):
    t = clean_lines.taxonomy_duplicates(lines(spark, sf), P)
    return t.select("level_2", F.col("n_parents").cast("long").alias("n_parents"))


def q_rpt_po_lines_by_class(spark, sf):
    return clean_lines.po_lines_by_class(lines(spark, sf), P)


def q_rpt_unit_summary(spark, sf):
    return unit_summary.unit_summary(lines(spark, sf), P)


def q_rpt_unit_summary_display(spark, sf):
    return unit_summary.unit_summary_display(lines(spark, sf), P)


def q_rpt_spend_bin_flag(spark, sf):
    return spend_bins.spend_bin_flag(lines(spark, sf), P)


def q_rpt_spend_bins(spark, sf):
    return spend_bins.spend_bins(lines(spark, sf), P)


def q_rpt_spend_bins_positional(spark, sf):
    """The bins under the status test as written, over a Parquet extract of
    the lines: its ids are the rows' places, so nothing is sorted."""
    path = _scratch(spark, "extract")
    sheet = lines(spark, sf).orderBy("line_id").drop("line_id")
    sheet.withColumnsRenamed(canonical_to_sheet("working")).write.parquet(path)
    extract = files.read_po_lines_parquet(spark, path, layout="working")
    return spend_bins.spend_bins(extract, replace(P, status_rule="positional", line_ids="dense"))


def q_rpt_month_files(spark, sf):
    """The separate month files: one month and one key each."""
    po = po_table(spark, sf)
    parts = [
        plat.one_month(po, key, m).select(F.lit(m).alias("month"), F.lit(key).alias("grouped_by"), F.col(key).alias("label"), "qty_of_pos", "total_spend")
        for m in P.report_months
        for key in ("platform", "buyer_type")
    ]
    return sets.union_all(*parts)


def q_rpt_po_platform(spark, sf):
    return plat.po_platform_report(lines(spark, sf), bids(spark, sf), P)


def q_rpt_platform_summary(spark, sf):
    return plat.platform_summary(po_table(spark, sf))


def q_rpt_uncategorized_size(spark, sf):
    return plat.uncategorized_size(po_table(spark, sf), P)


def q_rpt_buyer_type(spark, sf):
    return plat.buyer_type_summary(po_table(spark, sf))


def q_rpt_vendors_by_platform(spark, sf):
    return plat.vendors_by_platform(po_table(spark, sf))


def q_rpt_month_platform(spark, sf):
    return plat.month_summary(po_table(spark, sf), "platform", P)


def q_rpt_month_buyer_type(spark, sf):
    return plat.month_summary(po_table(spark, sf), "buyer_type", P)


def q_rpt_po_extract(spark, sf):
    return plat.po_extract(po_table(spark, sf))


def q_rpt_platform_under_limit(spark, sf):
    return plat.platform_under_limit(po_table(spark, sf), P)


def q_rpt_vendor_totals(spark, sf):
    return vendors.vendor_totals(lines(spark, sf), P)


def q_rpt_top_vendors(spark, sf):
    return vendors.top_vendors(lines(spark, sf), P)


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
