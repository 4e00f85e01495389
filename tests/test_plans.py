"""Physical-plan properties the reports rely on at scale."""

from __future__ import annotations

import pytest

from spendlens import catalog
from spendlens.explain import final_plan
from spendlens.operators import first_per_key
from spendlens.params import DEFAULT_PARAMS as P
from spendlens.plans import platform as plat, spend_bins
from tests.conftest import SF_SMALL


def _final_plan(df) -> str:
    return final_plan(df)


def test_status_filter_pushed_to_scan(spark):
    plan = _final_plan(spend_bins.spend_bins(catalog.lines(spark, SF_SMALL), P))
    assert "Not(In(o_orderstatus" in plan


def test_first_per_key_limits_before_the_shuffle(lines_factory):
    lines = lines_factory([dict(po_no=i % 3, line_id=i) for i in range(30)])
    plan = first_per_key(lines, ["po_no"], ["line_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_per_po_aggregate_combines_map_side(lines_factory, bids_factory):
    lines = lines_factory([dict(po_no=1, line_id=i) for i in range(20)])
    plan = _final_plan(plat.po_rows(lines))
    assert "partial_sum" in plan and "partial_min" in plan


@pytest.mark.parametrize(
    "name",
    ["rpt_spend_bins", "rpt_unit_summary", "rpt_po_platform", "rpt_vendors_by_platform", "rpt_platform_summary"],
)
def test_headline_reports_read_lines_once(spark, name):
    plan = _final_plan(catalog.queries()[name](spark, SF_SMALL))
    assert plan.count("FileScan parquet [l_orderkey") == 1


def test_no_single_partition_exchange_below_report_level(spark):
    """SinglePartition exchanges appear only above the last aggregate (the
    report rows), never on line-level data."""
    plan = _final_plan(catalog.queries()["rpt_unit_summary"](spark, SF_SMALL))
    lines = plan.splitlines()
    scan_depth = min(len(l) - len(l.lstrip(" :+-")) for l in lines if "FileScan parquet [l_orderkey" in l)
    for l in lines:
        if "SinglePartition" in l:
            depth = len(l) - len(l.lstrip(" :+-"))
            assert depth < scan_depth - 20


@pytest.fixture(scope="module")
def landed(spark):
    import tempfile

    from spendlens.sources.files import land_po_lines

    path = tempfile.mkdtemp(prefix="spendlens-landed-") + "/lines"
    land_po_lines(catalog.lines(spark, SF_SMALL), path)
    return spark.read.parquet(path)


def _above(plan: str, scan: str) -> list[str]:
    """The operators between the plan's top and its scan line."""
    lines = plan.splitlines()
    at = next(i for i, l in enumerate(lines) if scan in l)
    return lines[: at + 1]


def test_unit_summary_has_one_line_level_exchange(landed):
    from spendlens.plans import unit_summary

    plan = _final_plan(unit_summary.unit_rows(unit_summary.unit_and_po_rollup(landed, P)))
    assert plan.count("FileScan parquet") == 1
    exchanges = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l]
    # (unit, PO) rows once; then rows per unit code
    assert len(exchanges) == 3 and sum("po_no" in l for l in exchanges) == 1
    assert all("code" in l for l in exchanges if "po_no" not in l)
    # nothing is sorted between the lines and the rows per unit
    first_unit = next(i for i, l in enumerate(plan.splitlines()) if "hashpartitioning(code" in l and "unit" in l)
    assert not any("Sort " in l or "SortAggregate" in l for l in plan.splitlines()[first_unit:])


def test_covered_year_prunes_folders_for_the_unit_summary(spark, landed):
    import datetime as dt
    from dataclasses import replace

    from spendlens.params import Period
    from spendlens.plans import unit_summary

    year = Period("fy97", dt.date(1997, 7, 1), dt.date(1998, 7, 1))
    p = replace(P, year=year)
    plan = _final_plan(unit_summary.unit_summary(landed, p))
    scan = next(l for l in plan.splitlines() if "FileScan parquet" in l)
    assert ">= 1997)" in scan.split("PartitionFilters")[1] and "GreaterThanOrEqual(po_date,1997-07-01)" in scan
    own = landed.where("po_date >= '1997-07-01' and po_date < '1998-07-01'").drop("fiscal_year")
    want = [tuple(r) for r in unit_summary.unit_summary(own, P).collect()]
    assert [tuple(r) for r in unit_summary.unit_summary(landed, p).collect()] == want and len(want) > 5


def test_positional_rule_over_an_extract_sorts_nothing(spark, landed):
    import tempfile
    from dataclasses import replace

    from spendlens.operators.filters import exclude_statuses_positional, require_dense, status_filter
    from spendlens.sources.files import read_po_lines_parquet

    path = tempfile.mkdtemp(prefix="spendlens-extract-") + "/x"
    landed.drop("line_id", "fiscal_year").repartition(5).write.parquet(path)
    extract = read_po_lines_parquet(spark, path)
    require_dense(extract, "line_id")
    kept = status_filter(extract, replace(P, status_rule="positional", line_ids="dense"))
    plan = _final_plan(kept)
    assert "Sort" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    want = exclude_statuses_positional(extract, P.excluded_statuses, ["line_id"])
    assert sorted(r.line_id for r in kept.collect()) == sorted(r.line_id for r in want.collect())
    with pytest.raises(ValueError, match="not 1"):
        require_dense(extract.where("line_id <> 7"), "line_id")


def test_vendor_ranks_sort_within_bins(spark):
    plan = _final_plan(catalog.queries()["rpt_vendor_totals"](spark, SF_SMALL))
    assert "rangepartitioning" not in plan and plan.count("FileScan parquet [l_orderkey") == 1


def test_rank_by_bins_is_a_full_sort(spark):
    import random

    from spendlens.operators.ordering import rank_by_bins

    rng = random.Random(3)
    values = [None, 0.0, -0.0, 5.0, 5.0, -3.25, 1e17, -1e17, 1e-9] + [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(0, 12) for _ in range(500)]
    df = spark.createDataFrame([(f"v{i:04d}" if i % 50 else None, v) for i, v in enumerate(values)], "vendor string, total double")
    got = rank_by_bins(df, "total", ["vendor"], "rank").orderBy("rank").collect()
    key = lambda r: (r[1] is None, -(r[1] or 0.0), r[0] is None, r[0] or "")
    assert [(r.vendor, r.total) for r in got] == [tuple(r) for r in sorted(df.collect(), key=key)]
    assert [r["rank"] for r in got] == list(range(1, len(values) + 1))
