"""Cleaned PO lines and their lookups: as-of dates, taxonomy duplicates,
trailing-month flags, explicit taxonomy, buyer classes, (unit, PO) totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.classify import buyer_class, explicit_taxonomy
from spendlens.functions.dates import fiscal_year_start, months_before, years_before
from spendlens.operators.filters import amount_nonneg, covered, status_filter
from spendlens.operators.joins import broadcast_if_small
from spendlens.operators.totals import attach_group_total
from spendlens.params import DEFAULT_PARAMS, SpendParams
from spendlens.session import ensure_checkpoint_dir


def as_of_dates(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """One row: as-of date (latest ``as_of_column``, or ``p.as_of_date``),
    one and two months before it, and the first day of its fiscal year."""
    if p.as_of_date is not None:
        d = lines.sparkSession.range(1).select(F.lit(p.as_of_date).alias("as_of_date"))
    else:
        d = lines.agg(F.to_date(F.max(p.as_of_column)).alias("as_of_date"))
    return d.select(
        "as_of_date",
        months_before("as_of_date", 1).alias("last_month"),
        months_before("as_of_date", 2).alias("two_months_ago"),
        fiscal_year_start("as_of_date", p.fiscal_year_start_month).alias("fy_day_1"),
        years_before("as_of_date", 1).alias("year_ago"),
    )


def _as_of(lines: DataFrame, p: SpendParams) -> Column:
    """The trailing-window bounds as one scalar subquery: a struct of
    (as-of - 1 month, as-of - 2 months), computed once, not joined; a
    literal when ``p.as_of_date`` is given."""
    if p.as_of_date is not None:
        d = F.lit(p.as_of_date)
        return F.struct(months_before(d, 1).alias("m1"), months_before(d, 2).alias("m2"))
    as_of = F.to_date(F.max(p.as_of_column))
    return lines.agg(
        F.struct(months_before(as_of, 1).alias("m1"), months_before(as_of, 2).alias("m2"))
    ).scalar()


def taxonomy_parent_counts(lines: DataFrame) -> DataFrame:
    """Distinct ``level_1`` parents per ``level_2`` (distinct pairs, then a
    count; both steps combine map-side)."""
    return (
        lines.select("level_1", "level_2")
        .distinct()
        .groupBy("level_2")
        .agg(F.count(F.lit(1)).alias("n_parents"))
    )


def taxonomy_duplicates(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """``level_2`` values with exactly ``taxonomy_parents`` distinct
    ``level_1`` parents."""
    return taxonomy_parent_counts(lines).where(_is_duplicate(F.col("n_parents"), p))


def _is_duplicate(n_parents, p: SpendParams):
    if p.taxonomy_match == "at_least":
        return n_parents >= p.taxonomy_parents
    return n_parents == p.taxonomy_parents


def period_flags(lines: DataFrame, bounds: Column) -> DataFrame:
    """``in_last_1_month``: after as-of - 1 month; ``in_last_2_months``:
    after as-of - 2 months (no upper bound, so it includes the last month).
    NULL date -> NULL flag. ``bounds`` is ``_as_of``'s struct; it is
    projected once so the subquery runs once."""
    d = F.col("po_date")
    with_bounds = lines.withColumn("_bounds", bounds)
    return with_bounds.withColumn("in_last_1_month", d > F.col("_bounds.m1")).withColumn(
        "in_last_2_months", d > F.col("_bounds.m2")
    ).drop("_bounds")


def with_explicit_taxonomy(lines: DataFrame, taxonomy: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Add ``explicit_taxonomy_2``. ``taxonomy`` is the per-``level_2``
    parent count of the whole table (``taxonomy_parent_counts``); every
    line's ``level_2`` is in it, NULL included, so one NULL-safe left join
    (broadcast when the size check allows) gives each line its count."""
    t = taxonomy.select(F.col("level_2").alias("_tx_l2"), F.col("n_parents").alias("_tx_n"))
    joined = lines.join(t, lines["level_2"].eqNullSafe(t["_tx_l2"]), "left")
    dup = F.coalesce(_is_duplicate(F.col("_tx_n"), p), F.lit(False))
    return joined.withColumn(
        "explicit_taxonomy_2", explicit_taxonomy("level_1", "level_2", dup)
    ).drop("_tx_l2", "_tx_n")


CLEAN_OUT = [
    "po_no", "unit", "status", "sum_amount", "po_date", "buyer", "level_1", "level_2",
    "origin", "req_id", "vendor", "quote_link",
]


def line_lookups(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Both whole-table lookups of the cleaned-lines report in one pass: per
    ``level_2`` the number of distinct ``level_1`` parents (``n_parents``)
    and the latest ``as_of_column`` value (``latest``). Distinct pairs, then
    per ``level_2``; both steps combine map-side. One row per ``level_2``."""
    pairs = lines.groupBy("level_2", "level_1").agg(F.max(p.as_of_column).alias("_latest"))
    return pairs.groupBy("level_2").agg(
        F.count(F.lit(1)).alias("n_parents"), F.max("_latest").alias("latest")
    )


def clean_po_lines(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Lines with an allowed status and amount >= 0, flagged and classified.

    The taxonomy counts and the as-of date come from *all* lines (before
    the filters). Both come from one lookup aggregate, checkpointed once
    (one row per ``level_2``) in the session's checkpoint folder, so the
    lines are read twice in all: once for the lookup, once for the output.
    The lookup is broadcast after an exact size check (the checkpoint keeps
    the aggregate's huge size estimate, so the planner would not).
    """
    lines = covered(lines, p)
    ensure_checkpoint_dir(lines.sparkSession)
    # one row per level_2: broadcast after an exact row count, else a join
    lookups = broadcast_if_small(line_lookups(lines, p).checkpoint(eager=True))
    if p.as_of_date is not None:
        bounds = _as_of(lines, p)
    else:
        as_of = F.to_date(F.max("latest"))
        bounds = lookups.agg(
            F.struct(months_before(as_of, 1).alias("m1"), months_before(as_of, 2).alias("m2"))
        ).scalar()
    clean = lines.transform(status_filter, p).transform(amount_nonneg)
    return (
        clean.transform(period_flags, bounds)
        .transform(with_explicit_taxonomy, lookups, p)
        .withColumn("buyer_classification", buyer_class("buyer", p))
    )


def clean_po_lines_report(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    out = clean_po_lines(lines, p)
    return out.select(
        *[F.col(c).cast("double").alias(c) if c == "sum_amount" else F.col(c) for c in CLEAN_OUT],
        "in_last_1_month", "in_last_2_months", "explicit_taxonomy_2", "buyer_classification",
    )


def unit_po_total_lines(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """Cleaned lines with the (unit, PO) total attached."""
    clean = lines.transform(status_filter, p).transform(amount_nonneg)
    return attach_group_total(clean, ["unit", "po_no"], "sum_amount", "po_total_amount")


def po_lines_by_class(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """(unit, PO, buyer class) -> line count."""
    clean = lines.transform(status_filter, p).transform(amount_nonneg)
    return (
        clean.withColumn("buyer_classification", buyer_class("buyer", p))
        .groupBy("unit", "po_no", "buyer_classification")
        .agg(F.count(F.lit(1)).alias("po_line_count"))
    )
