"""The export set: every report written as CSV in one run.

The per-PO platform table feeds nine of the reports, so it is
materialized once with a reliable ``checkpoint()`` in the session's
checkpoint folder (a shared folder on a cluster): the lines are read for it
once, and a lost executor does not force the PO table to be rebuilt from
the lines. The line-level reports (unit summary, bins, vendor totals) read
the lines themselves, each in one pass.

As a job: ``python -m spendlens.cli export`` (see ``spendlens.cli``).
"""

from __future__ import annotations

import calendar
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.ordering import level_rank
from spendlens.labels import BIN_LEVELS
from spendlens.params import DEFAULT_PARAMS, SpendParams
from spendlens.plans import platform as plat
from spendlens.plans import spend_bins, unit_summary, vendors
from spendlens.session import ensure_checkpoint_dir
from spendlens.sinks.csv import write_csv, write_csv_numbered


def _asc(*cols: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def report_set(
    lines: DataFrame, po: DataFrame, p: SpendParams
) -> dict[str, tuple[Callable[[], DataFrame], list[Column], bool]]:
    """name -> (report builder, row order, numbered). Numbered files carry
    the leading 1..n row-name column; grouped summaries are ordered by their
    key, like the grouped tables they stand for."""
    return {
        "vendor_totals": (lambda: vendors.vendor_totals(lines, p), _asc("vendor_rank"), False),
        "top_vendors": (lambda: vendors.top_vendors(lines, p), _asc("vendor_rank"), False),
        "unit_summary": (lambda: unit_summary.unit_summary_display(lines, p), [], False),
        "spend_bins": (
            lambda: spend_bins.spend_bins(lines, p),
            [level_rank("bin_level", BIN_LEVELS).asc_nulls_last()],
            True,
        ),
        "platform_summary": (lambda: plat.platform_summary(po), _asc("platform"), True),
        "buyer_type_summary": (lambda: plat.buyer_type_summary(po), _asc("buyer_type"), True),
        **{
            f"{calendar.month_abbr[m].lower()}_{key}": (functools.partial(plat.one_month, po, key, m), _asc(key), True)
            for m in p.report_months
            for key in ("platform", "buyer_type")
        },
        "vendors_by_platform": (lambda: plat.vendors_by_platform(po), _asc("platform"), True),
        "uncategorized_size": (lambda: plat.uncategorized_size(po, p), _asc("size"), True),
        "platform_under_limit": (lambda: plat.platform_under_limit(po, p), _asc("platform"), True),
    }


def export_reports(
    lines: DataFrame,
    bids: DataFrame,
    out_dir: str,
    p: SpendParams = DEFAULT_PARAMS,
    materialize_po: bool = True,
) -> list[str]:
    """Write every report under ``out_dir/<name>``; returns the names."""
    po = plat.po_platform(lines, bids, p)
    if materialize_po:
        ensure_checkpoint_dir(lines.sparkSession)
        po = po.checkpoint(eager=True)
    written = []
    for name, (build, order, numbered) in report_set(lines, po, p).items():
        df = build()
        path = f"{out_dir}/{name}"
        if numbered:
            write_csv_numbered(df, path, order_by=order or None)
        else:
            write_csv(df, path, order_by=order or None)
        written.append(name)
    return written
