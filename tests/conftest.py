from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import build_session

    s = build_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


_DEFAULTS = dict(
    po_no=1,
    unit="U1",
    status="F",
    sum_amount="10.000",
    po_date=dt.date(2018, 4, 10),
    last_dttm=None,
    buyer="B5",
    level_1="L1A",
    level_2="bolt",
    origin="PUR",
    req_id=None,
    bid_category=None,
    vendor="V1",
    quote_link="none",
)


def make_lines(spark, rows):
    """Canonical PO lines from dicts (missing keys take defaults); line_id is
    the position in ``rows`` unless given."""
    from spendlens.schema import PO_LINE_SCHEMA

    data = []
    for i, r in enumerate(rows):
        d = dict(_DEFAULTS)
        d.update(r)
        d.setdefault("line_id", i + 1)
        amt = d["sum_amount"]
        d["sum_amount"] = None if amt is None else Decimal(str(amt))
        data.append(tuple(d[f.name] for f in PO_LINE_SCHEMA.fields))
    return spark.createDataFrame(data, PO_LINE_SCHEMA)


def make_bids(spark, ids):
    from spendlens.schema import BID_SCHEMA

    return spark.createDataFrame([(i,) for i in ids], BID_SCHEMA)


@pytest.fixture
def lines_factory(spark):
    return lambda rows: make_lines(spark, rows)


@pytest.fixture
def bids_factory(spark):
    return lambda ids: make_bids(spark, ids)
