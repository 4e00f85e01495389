"""Reports against plain-Python brute force of the row-wise semantics, on
random small fixtures with NULLs, repeated keys and a hot PO."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from spendlens import labels as L
from spendlens.params import DEFAULT_PARAMS as P
from spendlens.plans import platform as plat
from spendlens.plans import unit_summary
from tests.conftest import make_bids, make_lines


def _fixture(seed: int, n: int = 300):
    rnd = random.Random(seed)
    units = ["U1", "U2", "U3", None]
    statuses = ["F", "O", "P", "PX", None]
    dates = [dt.date(1998, 3, 30), dt.date(1998, 4, 1), dt.date(1998, 4, 30), dt.date(1998, 5, 1),
             dt.date(1998, 5, 31), dt.date(1998, 6, 1), None]
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.3
        rows.append(
            dict(
                line_id=rnd.randrange(10**9) * 1000 + i,
                po_no=0 if hot else rnd.choice([None, *range(1, 40)]),
                unit=rnd.choice(units),
                status=rnd.choice(statuses),
                sum_amount=rnd.choice([None, "0", "12.5", "-3.25", "4000.125", "60000"]),
                po_date=rnd.choice(dates),
                last_dttm=dt.datetime(1998, rnd.randrange(3, 6), rnd.randrange(1, 29), 13),
                buyer=rnd.choice([None, "B0", "B4", "B10", "B20", "B99"]),
                origin=rnd.choice([None, "SWC", "PUR"]),
                req_id=rnd.choice([None, "r1", "r2", "r3"]),
                vendor=rnd.choice([None, "V1", "V2", "V3", "V4"]),
                quote_link=rnd.choice([None, "http://q", "none"]),
            )
        )
    bids = rnd.choice([["r1", None], ["r2"], ["r1", "r3", None, "r1"]])
    return rows, bids


def _dec(x):
    return None if x is None else Decimal(x)


def _sum(vals):
    vals = [v for v in vals if v is not None]
    return sum(vals, Decimal(0)) if vals else None


def brute_platform(rows, bids):
    bid_set = set(bids)
    by_po = defaultdict(list)
    for r in rows:
        by_po[r["po_no"]].append(r)
    out = {}
    for po, rs in by_po.items():
        first = min(rs, key=lambda r: r["line_id"])
        if first["origin"] is None:
            platform = L.PLATFORM_NONE
        elif first["origin"] == "SWC":
            platform = L.PLATFORM_SWC
        elif first["req_id"] in bid_set:  # None matches None, like %in%
            platform = L.PLATFORM_BID_LOG
        elif first["quote_link"] is None:
            platform = L.PLATFORM_NONE
        elif first["quote_link"].startswith("h"):
            platform = L.PLATFORM_QUOTE
        else:
            platform = L.PLATFORM_NONE
        out[po] = (platform, _sum(_dec(r["sum_amount"]) for r in rs), first["vendor"], first["line_id"])
    return out


def brute_unit_summary(rows):
    clean = [r for r in rows if r["status"] is not None and r["status"] not in P.excluded_statuses]

    def in_p(r, per):
        return r["po_date"] is not None and per.start <= r["po_date"] < per.end

    def firsts(rs):
        by_po = {}
        for r in rs:
            if r["po_no"] not in by_po or r["line_id"] < by_po[r["po_no"]]["line_id"]:
                by_po[r["po_no"]] = r
        counts = defaultdict(int)
        for r in by_po.values():
            counts[r["unit"]] += 1
        return counts

    out = {}
    units = {r["unit"] for r in clean}
    a = [r for r in clean if in_p(r, P.period_a)]
    b = [r for r in clean if in_p(r, P.period_b)]
    ca, cb, cy = firsts(a), firsts(b), firsts(clean)
    for u in units:
        spend = lambda rs: _sum(_dec(r["sum_amount"]) for r in rs if r["unit"] == u) or Decimal(0)
        out[u] = (
            float(spend(clean)), cy.get(u, 0),
            float(spend(a)), ca.get(u, 0),
            float(spend(b)), cb.get(u, 0),
        )
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_platform_table_matches_brute_force(spark, seed):
    rows, bids = _fixture(seed)
    po = plat.po_platform(make_lines(spark, rows), make_bids(spark, bids), P)
    got = {r.po_no: (r.platform, r.amt, r.vendor, r.first_line_id) for r in po.collect()}
    assert got == brute_platform(rows, bids)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_unit_summary_matches_brute_force(spark, seed):
    rows, _ = _fixture(seed)
    got = {
        r.unit: (r.year_spend, r.year_pos, r.period_a_spend, r.period_a_pos, r.period_b_spend, r.period_b_pos)
        for r in unit_summary.unit_summary(make_lines(spark, rows), P).collect()
        if not r.is_total
    }
    assert got == brute_unit_summary(rows)


@pytest.mark.parametrize("seed", [7, 8])
def test_vendors_by_platform_matches_brute_force(spark, seed):
    rows, bids = _fixture(seed)
    table = brute_platform(rows, bids)
    first_po = {}
    for po, (platform, _, vendor, first_id) in table.items():
        if vendor not in first_po or first_id < first_po[vendor][0]:
            first_po[vendor] = (first_id, platform)
    vendors = defaultdict(int)
    for _, platform in first_po.values():
        vendors[platform] += 1
    pos = defaultdict(int)
    for platform, *_ in table.values():
        pos[platform] += 1
    want = {p: (n, pos[p]) for p, n in vendors.items()}
    po = plat.po_platform(make_lines(spark, rows), make_bids(spark, bids), P)
    got = {r.platform: (r.qty_of_vendors, r.qty_of_pos) for r in plat.vendors_by_platform(po).collect()}
    assert got == want


def brute_spend_bins(rows, positional: bool):
    codes = P.excluded_statuses
    ordered = sorted(rows, key=lambda r: r["line_id"])
    kept = []
    for i, r in enumerate(ordered):
        if r["status"] is None:
            continue
        if positional:
            if r["status"] == codes[i % len(codes)]:
                continue
        elif r["status"] in codes:
            continue
        amt = _dec(r["sum_amount"])
        if amt is None or amt < 0 or r["po_no"] is None:
            continue
        kept.append((r["po_no"], amt))
    totals = defaultdict(Decimal)
    for po, amt in kept:
        totals[po] += amt
    bins = defaultdict(lambda: [0, Decimal(0)])
    for t in totals.values():
        level = "Micro" if t <= P.micro_max else ("Small" if t < P.large_min else "Large")
        bins[level][0] += 1
        bins[level][1] += t
    return {k: (v[0], float(v[1])) for k, v in bins.items()}


@pytest.mark.parametrize("seed,positional", [(9, False), (10, True)])
def test_spend_bins_match_brute_force(spark, seed, positional):
    from dataclasses import replace

    from spendlens.plans import spend_bins

    rows, _ = _fixture(seed)
    p = replace(P, status_rule="positional" if positional else "set")
    got = {r.bin_level: (r.cnt, r.spend) for r in spend_bins.spend_bins(make_lines(spark, rows), p).collect()}
    assert got == brute_spend_bins(rows, positional)


@pytest.mark.parametrize("seed", [11, 12])
def test_vendor_totals_match_brute_force(spark, seed):
    from spendlens.plans import vendors

    rows, _ = _fixture(seed, n=400)
    u = "U1"
    sel = [r for r in rows if r["unit"] == u and r["buyer"] not in P.vendor_excluded_buyers]
    pos, tot = defaultdict(set), defaultdict(list)
    for r in sel:
        pos[r["vendor"]].add(r["po_no"])
        tot[r["vendor"]].append(_dec(r["sum_amount"]))
    table = {v: (len(pos[v]), _sum(tot[v])) for v in pos}
    order = sorted(
        table,
        key=lambda v: (table[v][1] is None, -(table[v][1] or 0), v is None, v or ""),
    )
    want = {v: (table[v][0], None if table[v][1] is None else float(table[v][1]), i + 1) for i, v in enumerate(order)}
    from dataclasses import replace

    p = replace(P, vendor_unit=u)
    got = {r.vendor: (r.num_pos, r.vendor_total, r.vendor_rank) for r in vendors.vendor_totals(make_lines(spark, rows), p).collect()}
    assert got == want


def _months_before(d: dt.date, n: int) -> dt.date:
    import calendar

    y, m = divmod(d.year * 12 + d.month - 1 - n, 12)
    m += 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


@pytest.mark.parametrize("seed", [13, 14])
def test_clean_lines_match_brute_force(spark, seed):
    from spendlens.plans import clean_lines

    rnd = random.Random(seed)
    rows, _ = _fixture(seed)
    for r in rows:
        r["level_2"] = rnd.choice(["bolt", "nut", "gear", None])
        r["level_1"] = rnd.choice(["X", "Y", "Z", None]) if r["level_2"] != "nut" else "X"
    parents = defaultdict(set)
    for r in rows:
        parents[r["level_2"]].add(r["level_1"])
    as_of = max(r["last_dttm"] for r in rows).date()
    m1, m2 = _months_before(as_of, 1), _months_before(as_of, 2)

    def cls(b):
        if b in P.class_sourcing_execs:
            return L.CLASS_SOURCING_EXEC
        if b in P.class_non_inventory:
            return L.CLASS_NON_INVENTORY
        if b in P.class_inventory:
            return L.CLASS_INVENTORY
        return L.CLASS_OUTSIDE if b is not None else L.CLASS_ERROR

    want = {}
    for r in rows:
        amt = _dec(r["sum_amount"])
        if r["status"] is None or r["status"] in P.excluded_statuses or amt is None or amt < 0:
            continue
        d = r["po_date"]
        dup = len(parents[r["level_2"]]) == P.taxonomy_parents
        tax = f"{r['level_2'] or 'NA'}_{r['level_1'] or 'NA'}" if dup else r["level_2"]
        want[r["line_id"]] = (
            None if d is None else d > m1,
            None if d is None else d > m2,
            tax,
            cls(r["buyer"]),
        )
    out = clean_lines.clean_po_lines(make_lines(spark, rows), P).collect()
    got = {
        r.line_id: (r.in_last_1_month, r.in_last_2_months, r.explicit_taxonomy_2, r.buyer_classification)
        for r in out
    }
    assert got == want
