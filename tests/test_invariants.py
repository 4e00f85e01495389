"""Invariants between reports and partition independence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendlens import catalog
from spendlens.operators.filters import exclude_statuses
from spendlens.params import DEFAULT_PARAMS as P
from spendlens.plans import platform as plat, spend_bins, unit_summary
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def lines(spark):
    return catalog.lines(spark, SF_SMALL)


@pytest.fixture(scope="module")
def po(spark):
    return catalog.po_table(spark, SF_SMALL)


def test_bins_sum_to_po_totals(lines):
    bins = spend_bins.spend_bins(lines, P).collect()
    po = spend_bins.po_totals_for_bins(lines, P)
    n, total = po.agg(F.count("*"), F.sum("po_total_amt").cast("double")).first()
    assert sum(r.cnt for r in bins) == n
    assert abs(sum(r.spend for r in bins) - total) < 1e-6


def test_platform_counts_are_distinct_pos(lines, po):
    summary = plat.platform_summary(po).collect()
    distinct = lines.select("po_no").distinct().count()
    assert sum(r.qty_of_pos for r in summary) == distinct


def test_subset_and_complement_cover_all(po):
    tagged = plat.buyer_subsets(po, P)
    assert tagged.count() == po.count()


def test_total_row_is_column_sum_and_counts_match_distinct_pos(lines):
    rows = unit_summary.unit_summary(lines, P).collect()
    body = [r for r in rows if not r.is_total]
    total = [r for r in rows if r.is_total][0]
    for c in ("year_pos", "period_a_pos", "period_b_pos"):
        assert sum(getattr(r, c) for r in body) == getattr(total, c)
    for c in ("year_spend", "period_a_spend", "period_b_spend"):
        assert abs(sum(getattr(r, c) for r in body) - getattr(total, c)) < 1e-6
    clean = lines.transform(exclude_statuses, P.excluded_statuses)
    assert total.year_pos == clean.select("po_no").distinct().count()
    a = P.period_a
    in_a = clean.where((F.col("po_date") >= F.lit(a.start)) & (F.col("po_date") < F.lit(a.end)))
    assert total.period_a_pos == in_a.select("po_no").distinct().count()
    # report order: YTD spend descending, total last
    spends = [r.year_spend for r in body]
    assert spends == sorted(spends, reverse=True) and rows[-1].is_total


@pytest.mark.parametrize(
    "name",
    [
        "rpt_unit_summary", "rpt_po_platform", "rpt_vendors_by_platform", "rpt_vendor_totals",
        "rpt_spend_bins", "rpt_clean_po_lines", "op_status_cycle", "op_first_per_key",
    ],
)
def test_partition_independence(spark, name):
    """Same answer with 1 and 200 shuffle partitions and with the input rows
    shuffled: order comes only from line_id."""
    q = catalog.queries()[name]

    def run(parts, shuffle):
        prev = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            base = catalog.tb.po_lines(spark, SF_SMALL)
            if shuffle:
                base = base.repartition(5, F.rand(seed=7))
            catalog._PLANS[(spark.sparkContext.applicationId, SF_SMALL, "lines")] = base
            catalog._PLANS.pop((spark.sparkContext.applicationId, SF_SMALL, "po"), None)
            return [tuple(r) for r in q(spark, SF_SMALL).collect()]
        finally:
            catalog._PLANS.pop((spark.sparkContext.applicationId, SF_SMALL, "lines"), None)
            catalog._PLANS.pop((spark.sparkContext.applicationId, SF_SMALL, "po"), None)
            spark.conf.set("spark.sql.shuffle.partitions", prev)

    def key(t):
        return tuple((x is None, str(x)) for x in t)

    a = sorted(run(1, False), key=key)
    b = sorted(run(200, True), key=key)
    assert a == b
