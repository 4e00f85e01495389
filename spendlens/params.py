"""Report parameters.

The reference hard-codes staff ids, PO numbers, thresholds and periods in
its scripts. Here they are one value object passed to every report. The
defaults are the values that go with the test-table binding
(``sources.tpch_binding``): buyers are ``B<nation key>`` codes, status
``P`` stands for the ERP's ``PA``.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Period:
    """Half-open date range ``[start, end)`` with a short label."""

    label: str
    start: dt.date
    end: dt.date


def _b(*keys: int) -> tuple[str, ...]:
    return tuple(f"B{k}" for k in keys)


@dataclass(frozen=True)
class SpendParams:
    # Status codes removed before spend reporting. "set": a line is dropped
    # when its status is any of them (the evident intent); "positional": the
    # as-written recycled comparison, line i against code (i - 1) mod n in
    # line_id order.
    excluded_statuses: tuple[str, ...] = ("O", "P", "PX")
    status_rule: str = "set"
    # How line_id gives a line's position for the positional rule. "dense":
    # ids are 1..n over the whole input (what the Parquet reader gives), so
    # the id is the position; a number of bits: ids are group * 2^bits + dense
    # index (the test binding); None: any ids, the lines are sorted by them.
    line_ids: str | int | None = None

    # Days that the reports cover (None: all). On lines landed by fiscal year
    # only the folders of these days are read.
    year: Period | None = None

    # Two reporting periods of the business-unit summary (April, May).
    period_a: Period = Period("april", dt.date(1998, 4, 1), dt.date(1998, 5, 1))
    period_b: Period = Period("may", dt.date(1998, 5, 1), dt.date(1998, 6, 1))
    # Calendar months (any year) of the month x platform / buyer reports.
    report_months: tuple[int, ...] = (4, 5)

    # Column whose maximum is the as-of date of the trailing-month flags,
    # or a fixed as-of date (no pass over the lines for it).
    as_of_column: str = "last_dttm"
    as_of_date: dt.date | None = None
    fiscal_year_start_month: int = 7

    # Spend bins on PO totals: Micro <= micro_max < Small < large_min <= Large.
    micro_max: int = 3500
    large_min: int = 50000
    # Small-PO report: PO total <= small_po_max.
    small_po_max: int = 1000
    # Uncategorized-size split: total < size_split -> "<50,000".
    size_split: int = 50000

    # Buyer classes of the cleaned-lines report (first match wins).
    class_sourcing_execs: tuple[str, ...] = _b(0, 1, 2, 3)
    class_non_inventory: tuple[str, ...] = _b(4, 5, 6, 7, 8, 9)
    class_inventory: tuple[str, ...] = _b(10, 11, 12, 13)

    # Buyer types of the platform reports; the exec list is a subset of the
    # non-inventory list, so branch order decides.
    type_sourcing_execs: tuple[str, ...] = _b(0, 1, 2, 20)
    type_non_inventory: tuple[str, ...] = _b(0, 1, 2, 4, 5, 6, 7, 8, 9, 20, 21)
    type_inventory: tuple[str, ...] = _b(10, 11, 12, 13, 14, 15, 16)

    # PO numbers left out of the small-PO platform report.
    po_blacklist: tuple[int, ...] = (69, 92)

    # Vendor totals: one unit, some buyers excluded (NULL buyer kept).
    vendor_unit: str = "NATION_15"
    vendor_excluded_buyers: tuple[str, ...] = _b(1, 2, 3)
    # Top-vendor threshold in millions.
    vendor_min_total_mm: float = 2.35

    # Taxonomy: level_2 values with exactly this many level_1 parents get
    # the parent appended ("at_least": this many or more).
    taxonomy_parents: int = 2
    taxonomy_match: str = "exact"

    # Origin that marks the state-wide-contract platform / buyer.
    swc_origin: str = "SWC"
    # Quote-link prefix that marks the quoting platform.
    quote_prefix: str = "h"

    extra: dict = field(default_factory=dict)


DEFAULT_PARAMS = SpendParams()


def params_from_json(path: str) -> SpendParams:
    """Parameters from a JSON file: an object with any of the fields above.
    Lists become tuples; a period is {"label", "start", "end"} with ISO
    dates. Unknown names are an error; those left out keep their default."""
    with open(path) as f:
        given = json.load(f)
    known = {f.name for f in fields(SpendParams)}
    if given.keys() - known:
        raise ValueError(f"unknown parameters: {sorted(given.keys() - known)}")

    def value(name, v):
        if name in ("period_a", "period_b", "year") and v is not None:
            return Period(v["label"], dt.date.fromisoformat(v["start"]), dt.date.fromisoformat(v["end"]))
        if name == "as_of_date" and v is not None:
            return dt.date.fromisoformat(v)
        return tuple(v) if isinstance(v, list) else v

    return replace(DEFAULT_PARAMS, **{k: value(k, v) for k, v in given.items()})
