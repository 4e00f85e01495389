"""Reports on hand-made edge rows (FIXTURES.md section D)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from spendlens import labels as L
from spendlens.params import DEFAULT_PARAMS as P
from spendlens.plans import clean_lines, platform as plat, spend_bins, unit_summary, vendors


def test_platform_null_rules(lines_factory, bids_factory):
    lines = lines_factory(
        [
            # NULL origin with a matching requisition -> Uncategorized
            dict(po_no=1, origin=None, req_id="r1"),
            # NULL requisition and the bid log holds a NULL -> Business Center
            dict(po_no=2, origin="PUR", req_id=None),
            # NULL quote link -> Uncategorized
            dict(po_no=3, origin="PUR", req_id="zz", quote_link=None),
            dict(po_no=4, origin="PUR", req_id="zz", quote_link="http://q"),
            dict(po_no=5, origin="SWC", req_id="r1"),
            # only the first line of a PO decides
            dict(po_no=6, origin="PUR", req_id="zz", quote_link="none", line_id=100),
            dict(po_no=6, origin="SWC", line_id=101),
        ]
    )
    bids = bids_factory(["r1", None])
    po = plat.po_platform(lines, bids, P)
    got = {r.po_no: r.platform for r in po.collect()}
    assert got == {
        1: L.PLATFORM_NONE,
        2: L.PLATFORM_BID_LOG,
        3: L.PLATFORM_NONE,
        4: L.PLATFORM_QUOTE,
        5: L.PLATFORM_SWC,
        6: L.PLATFORM_NONE,
    }
    # without a NULL in the bid log a NULL requisition does not match
    po2 = plat.po_platform(lines, bids_factory(["r1"]), P)
    assert {r.po_no: r.platform for r in po2.collect()}[2] == L.PLATFORM_NONE


def test_buyer_type_null_origin_vs_na_text(lines_factory, bids_factory):
    lines = lines_factory(
        [
            dict(po_no=1, origin=None, buyer="B0"),
            dict(po_no=2, origin="PUR", buyer="B99"),
            dict(po_no=3, origin="PUR", buyer="B0"),  # exec list wins over non-inventory
            dict(po_no=4, origin="PUR", buyer=None),
        ]
    )
    po = plat.po_platform(lines, bids_factory(["x"]), P)
    got = {r.po_no: r.buyer_type for r in po.collect()}
    assert got == {1: None, 2: L.TYPE_NONE, 3: L.TYPE_SOURCING_EXEC, 4: L.TYPE_NONE}


def test_spend_bin_limits(lines_factory):
    totals = ["3500", "3500.01", "49999.99", "50000", "1000", "0"]
    lines = lines_factory([dict(po_no=i, sum_amount=t) for i, t in enumerate(totals)])
    po = spend_bins.po_totals_for_bins(lines, P)
    from spendlens.functions.classify import spend_bin

    got = {r.po_no: r.b for r in po.select("po_no", spend_bin("po_total_amt", P).alias("b")).collect()}
    assert got == {0: "Micro", 1: "Small", 2: "Small", 3: "Large", 4: "Micro", 5: "Micro"}
    out = {r.bin_level: r.cnt for r in spend_bins.spend_bins(lines, P).collect()}
    assert out == {"Micro": 3, "Small": 2, "Large": 1}


def test_spend_bins_percent_sums_to_100(spark):
    from spendlens import catalog

    rows = spend_bins.spend_bins(catalog.lines(spark, "/root/testdata/sf0.001"), P).collect()
    assert abs(sum(r.pct_cnt for r in rows) - 100) < 1e-9
    assert abs(sum(r.pct_spend for r in rows) - 100) < 1e-9
    assert [r.bin_level for r in rows] == ["Micro", "Small", "Large"]


def test_first_row_attribution_per_period(lines_factory):
    a = P.period_a
    lines = lines_factory(
        [
            # PO 1 starts in unit A (all year) but its first April line is in B
            dict(po_no=1, unit="A", po_date=dt.date(1998, 3, 1), line_id=1),
            dict(po_no=1, unit="B", po_date=a.start, line_id=2),
            dict(po_no=1, unit="A", po_date=a.start, line_id=3),
            dict(po_no=2, unit="B", po_date=dt.date(1998, 5, 2), line_id=4),
        ]
    )
    rows = {r.unit: r for r in unit_summary.unit_summary(lines, P).collect()}
    assert rows["A"].year_pos == 1 and rows["A"].period_a_pos == 0
    assert rows["B"].year_pos == 1 and rows["B"].period_a_pos == 1 and rows["B"].period_b_pos == 1
    total = rows["Total"]
    assert total.is_total and total.year_pos == 2 and total.year_spend == 40.0


def test_small_po_limit_and_blacklist(lines_factory, bids_factory):
    black = P.po_blacklist[0]
    lines = lines_factory(
        [
            dict(po_no=1, sum_amount="1000"),
            dict(po_no=2, sum_amount="1000.01"),
            dict(po_no=black, sum_amount="5"),
            dict(po_no=None, sum_amount="7"),
        ]
    )
    po = plat.po_platform(lines, bids_factory(["x"]), P)
    out = plat.platform_under_limit(po, P).collect()
    assert sum(r.qty_of_pos for r in out) == 2  # PO 1 and the NULL PO


def test_taxonomy_parents(lines_factory):
    lines = lines_factory(
        [
            dict(level_2="one", level_1="X"),
            dict(level_2="two", level_1="X"),
            dict(level_2="two", level_1="Y"),
            dict(level_2="three", level_1="X"),
            dict(level_2="three", level_1="Y"),
            dict(level_2="three", level_1="Z"),
        ]
    )
    dups = {r.level_2 for r in clean_lines.taxonomy_duplicates(lines, P).collect()}
    assert dups == {"two"}
    out = clean_lines.with_explicit_taxonomy(lines, clean_lines.taxonomy_parent_counts(lines), P)
    got = sorted(r.explicit_taxonomy_2 for r in out.collect())
    assert got == sorted(["one", "two_X", "two_Y", "three", "three", "three"])


def test_as_of_dates_end_of_month(lines_factory):
    lines = lines_factory([dict(last_dttm=dt.datetime(2018, 3, 31, 23)), dict(last_dttm=dt.datetime(2017, 1, 1)), dict(last_dttm=None)])
    r = clean_lines.as_of_dates(lines, P).collect()[0]
    assert r.as_of_date == dt.date(2018, 3, 31)
    assert r.last_month == dt.date(2018, 2, 28)
    assert r.two_months_ago == dt.date(2018, 1, 31)
    assert r.fy_day_1 == dt.date(2017, 7, 1)


def test_buyer_classes(lines_factory):
    lines = lines_factory(
        [
            dict(buyer="B0", line_id=1),
            dict(buyer="B4", line_id=2),
            dict(buyer="B10", line_id=3),
            dict(buyer="B23", line_id=4),
            dict(buyer=None, line_id=5),
        ]
    )
    out = clean_lines.clean_po_lines(lines, P).collect()
    got = {r.buyer: r.buyer_classification for r in out}
    assert got == {
        "B0": L.CLASS_SOURCING_EXEC,
        "B4": L.CLASS_NON_INVENTORY,
        "B10": L.CLASS_INVENTORY,
        "B23": L.CLASS_OUTSIDE,
        None: L.CLASS_ERROR,
    }


def test_vendor_totals_null_po_counts_once(lines_factory):
    u = P.vendor_unit
    lines = lines_factory(
        [
            dict(unit=u, vendor="V1", po_no=None, sum_amount="1"),
            dict(unit=u, vendor="V1", po_no=None, sum_amount="2"),
            dict(unit=u, vendor="V1", po_no=5, sum_amount="3"),
            dict(unit=u, vendor=None, po_no=6, sum_amount="10"),
            dict(unit=u, vendor="V2", po_no=7, sum_amount="1", buyer=P.vendor_excluded_buyers[0]),
            dict(unit=u, vendor="V3", po_no=8, sum_amount="1", buyer=None),
        ]
    )
    out = {r.vendor: r for r in vendors.vendor_totals(lines, P).collect()}
    assert set(out) == {"V1", None, "V3"}
    assert out["V1"].num_pos == 2 and out["V1"].vendor_total == 6.0
    assert out[None].vendor_rank == 1 and out["V1"].vendor_rank == 2 and out["V3"].vendor_rank == 3


def test_vendors_by_platform_first_po(lines_factory, bids_factory):
    lines = lines_factory(
        [
            dict(po_no=1, vendor="V1", origin="SWC", line_id=1),
            dict(po_no=2, vendor="V1", origin="PUR", quote_link="http://q", line_id=2),
            dict(po_no=3, vendor="V2", origin="PUR", quote_link="http://q", line_id=3),
        ]
    )
    po = plat.po_platform(lines, bids_factory(["x"]), P)
    out = {r.platform: (r.qty_of_vendors, r.qty_of_pos) for r in plat.vendors_by_platform(po).collect()}
    assert out == {L.PLATFORM_SWC: (1, 1), L.PLATFORM_QUOTE: (1, 2)}


def test_taxonomy_at_least_option(lines_factory):
    from dataclasses import replace

    lines = lines_factory(
        [
            dict(level_2="two", level_1="X"),
            dict(level_2="two", level_1="Y"),
            dict(level_2="three", level_1="X"),
            dict(level_2="three", level_1="Y"),
            dict(level_2="three", level_1="Z"),
        ]
    )
    p = replace(P, taxonomy_match="at_least")
    assert {r.level_2 for r in clean_lines.taxonomy_duplicates(lines, p).collect()} == {"two", "three"}


def test_null_unit_zero_fill_variants(lines_factory):
    lines = lines_factory([dict(unit=None, po_no=1), dict(unit="A", po_no=2)])
    default = {r.unit for r in unit_summary.unit_summary(lines, P).collect()}
    assert default == {None, "A", "Total"}
    as_written = {r.unit for r in unit_summary.unit_summary(lines, P, key_as_written=True).collect()}
    assert as_written == {"0", "A", "Total"}


def test_fixed_as_of_date(lines_factory):
    from dataclasses import replace

    lines = lines_factory([dict(po_date=dt.date(2018, 3, 20), line_id=1), dict(po_date=dt.date(2018, 5, 20), line_id=2)])
    p = replace(P, as_of_date=dt.date(2018, 3, 31))
    out = {r.po_date: (r.in_last_1_month, r.in_last_2_months) for r in clean_lines.clean_po_lines(lines, p).collect()}
    assert out == {dt.date(2018, 3, 20): (True, True), dt.date(2018, 5, 20): (True, True)}
    assert clean_lines.as_of_dates(lines, p).first().last_month == dt.date(2018, 2, 28)


def test_positional_status_rule_in_reports(lines_factory):
    from dataclasses import replace

    # line i is tested against ("O", "P", "PX")[(i - 1) % 3] only
    statuses = ["O", "O", "PX", "P", "F", "PX"]
    lines = lines_factory(
        [dict(po_no=i, status=s, sum_amount="-1" if i == 1 else "5", line_id=i + 1) for i, s in enumerate(statuses)]
    )
    p = replace(P, status_rule="positional")
    got = {r.bin_level: r.cnt for r in spend_bins.spend_bins(lines, p).collect()}
    # kept by position: lines 2, 4, 5 (po 1, 3, 4); po 1 has a negative amount
    assert got == {"Micro": 2}
    assert {r.bin_level: r.cnt for r in spend_bins.spend_bins(lines, P).collect()} == {"Micro": 1}
