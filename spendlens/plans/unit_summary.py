"""Business-unit summary: year-to-date, period-A and period-B spend and PO
counts per unit, zero-filled, largest YTD spend first, total row last.

PO counts: a PO is counted once, in the unit of its *first* line, and the
first line is chosen within each period separately.

Plan: the lines are read once and meet in one exchange. One hash aggregate
over the grouping sets (unit) and (PO) adds the spend per unit and finds each
PO's first line per period. That first line carries its unit along in one
fixed-width number, line_id * 2^63 + hash of the unit, so its minimum is a
plain hash aggregate, combined map-side: a hot PO or unit is one row per map
task before the exchange, and no line is sorted. What follows is a row per PO
and period, counted by unit hash, and report-sized tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.dates import in_period
from spendlens.functions.text import count_text, money_text
from spendlens.labels import UNIT_SUMMARY_DISPLAY
from spendlens.operators.filters import covered, status_filter
from spendlens.operators.ordering import sort_report
from spendlens.operators.totals import with_totals_row
from spendlens.params import DEFAULT_PARAMS, SpendParams

SPEND_COLS = ["year_spend", "period_a_spend", "period_b_spend"]
COUNT_COLS = ["year_pos", "period_a_pos", "period_b_pos"]
REPORT_COLS = ["unit", "year_spend", "year_pos", "period_a_spend", "period_a_pos", "period_b_spend", "period_b_pos"]


def _periods(p: SpendParams):
    return (
        in_period("po_date", p.period_a.start, p.period_a.end),
        in_period("po_date", p.period_b.start, p.period_b.end),
    )


_CODE = 1 << 63


def _unit_code() -> Column:
    """63 bits of the unit's hash. Units that share one are an error (``unit_rows``)."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("u"), "unit"), F.lit(""))).bitwiseAND(F.lit(_CODE - 1))


def unit_and_po_rollup(clean: DataFrame, p: SpendParams) -> DataFrame:
    """One row per unit (``is_po`` 0) with its spend overall / in A / in B,
    and one per PO (``is_po`` 1) with its first line overall / in A / in B as
    ``line_id * 2^63 + unit code``. All buffers are of fixed width."""
    in_a, in_b = _periods(p)
    amt = F.col("sum_amount")
    first = (F.col("line_id").cast("decimal(19,0)") * F.lit(Decimal(_CODE)) + F.col("_code")).cast("decimal(38,0)")
    coded = clean.select("unit", "po_no", "line_id", amt, "po_date", _unit_code().cast("decimal(19,0)").alias("_code"))
    return coded.groupingSets([["unit"], ["po_no"]], "unit", "po_no").agg(
        F.grouping("unit").alias("is_po"),
        F.sum(amt).alias("s_all"),
        F.sum(F.when(in_a, amt)).alias("s_a"),
        F.sum(F.when(in_b, amt)).alias("s_b"),
        F.min(first).alias("f_all"),
        F.min(F.when(in_a, first)).alias("f_a"),
        F.min(F.when(in_b, first)).alias("f_b"),
    )


def unit_rows(rollup: DataFrame) -> DataFrame:
    """Per-unit spend and first-line PO counts from the rollup, in one chain:
    a unit row gives its sums, a PO row one count for each period's first
    line, both under the unit's code."""
    own = F.col("is_po") == 0
    code = lambda c: F.pmod(c, F.lit(Decimal(_CODE))).cast("long")
    none = F.lit(None)

    def part(at: Column, n_all, n_a, n_b, spend: bool) -> Column:
        sums = [F.col(c) if spend else none.cast("decimal(28,3)") for c in ("s_all", "s_a", "s_b")]
        sums = [s.cast("decimal(28,3)").alias(c) for s, c in zip(sums, SPEND_COLS)]
        counts = [F.lit(n).cast("long").alias(c) for n, c in zip((n_all, n_a, n_b), COUNT_COLS)]
        return F.struct(at.alias("code"), F.lit(spend).alias("own"), *sums, *counts)

    firsts = F.array(part(code(F.col("f_all")), 1, 0, 0, False), part(code(F.col("f_a")), 0, 1, 0, False), part(code(F.col("f_b")), 0, 0, 1, False))
    found = F.filter(firsts, lambda r: r["code"].isNotNull())
    parts = F.when(own, F.array(part(_unit_code(), 0, 0, 0, True))).otherwise(found)
    each = rollup.select("unit", F.explode(parts).alias("r")).select("unit", "r.*")
    # at most two rows a unit: its own one, and the counts of PO rows
    sums = [F.sum(c).alias(c) for c in SPEND_COLS + COUNT_COLS]
    units = each.groupBy("code", "own", "unit").agg(*sums)
    same = F.when(F.count_if("own") == 1, F.max("unit")).otherwise(F.raise_error(F.lit("two units have the same hash")).cast("string"))
    return units.groupBy("code").agg(same.alias("unit"), *sums).drop("code")


def _joined(lines: DataFrame, p: SpendParams) -> DataFrame:
    """Per-unit spend with per-unit first-line PO counts. A count of 0
    becomes NULL: in the row-wise original such a unit is missing from the
    count table, so its left join leaves NA there."""
    clean = lines.transform(covered, p).transform(status_filter, p)
    joined = unit_rows(unit_and_po_rollup(clean, p))
    return joined.select(
        "unit",
        *SPEND_COLS,
        *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in COUNT_COLS],
    )


def unit_summary_unfilled(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """The joined per-unit table before zero-fill."""
    j = _joined(lines, p)
    return j.select(
        "unit",
        *[F.col(c).cast("double").alias(c) if c in SPEND_COLS else F.col(c).cast("long").alias(c) for c in REPORT_COLS[1:]],
    )


def _zero_filled_decimal(lines: DataFrame, p: SpendParams, key_as_written: bool = False) -> DataFrame:
    """``replace(is.na(.), 0)`` on the numeric columns. The original also
    fills the key column, printing a NULL unit as "0"; ``key_as_written``
    does that too (off by default: a NULL unit stays NULL)."""
    j = _joined(lines, p)
    zero = F.lit(0)
    unit = F.coalesce(F.col("unit"), F.lit("0")).alias("unit") if key_as_written else F.col("unit")
    return j.select(
        unit,
        *[F.coalesce(F.col(c), zero.cast(j.schema[c].dataType)).alias(c) for c in SPEND_COLS],
        *[F.coalesce(F.col(c), zero).cast("long").alias(c) for c in COUNT_COLS],
    )


def unit_summary(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS, key_as_written: bool = False) -> DataFrame:
    """Zero-filled per-unit summary with the total row appended (flag
    ``is_total``), ordered by YTD spend descending, total last."""
    filled = _zero_filled_decimal(lines, p, key_as_written)
    totals = with_totals_row(filled, "unit", SPEND_COLS + COUNT_COLS)
    return sort_report(totals, ["is_total", F.col("year_spend").desc_nulls_last()]).select(
        "unit",
        *[F.col(c).cast("double").alias(c) if c in SPEND_COLS else F.col(c) for c in REPORT_COLS[1:]],
        "is_total",
    )


def unit_summary_display(lines: DataFrame, p: SpendParams = DEFAULT_PARAMS) -> DataFrame:
    """The summary as printed: spend as ``$`` + rounded, comma-grouped,
    width-padded text; counts as comma-grouped padded text; display names."""
    filled = _zero_filled_decimal(lines, p)
    totals = with_totals_row(filled, "unit", SPEND_COLS + COUNT_COLS)
    shown = totals.select(
        "unit",
        "is_total",
        "year_spend",
        *[money_text(c).alias(UNIT_SUMMARY_DISPLAY[c]) for c in SPEND_COLS],
        *[count_text(c).alias(UNIT_SUMMARY_DISPLAY[c]) for c in COUNT_COLS],
    )
    ordered = [UNIT_SUMMARY_DISPLAY[c] for c in REPORT_COLS[1:]]
    return sort_report(shown, ["is_total", F.col("year_spend").desc_nulls_last()]).select(
        "unit", *[F.col(f"`{c}`") for c in ordered]
    )
