"""Canonical PO-line and bid-log schemas and the rename maps of the two
spreadsheet layouts.

Every operator works on the canonical snake_case names. ``line_id`` is a
long that encodes the input row order (unique, increasing in file order);
order-dependent operators (first row per key, positional status test,
first vendor row) sort on it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Money is kept as an exact decimal while it is summed, so totals do not
# depend on the order rows reach a task; reports cast to double at the end.
MONEY = T.DecimalType(18, 3)

PO_LINE_SCHEMA = T.StructType(
    [
        T.StructField("line_id", T.LongType(), False),
        T.StructField("po_no", T.LongType(), True),
        T.StructField("unit", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("sum_amount", MONEY, True),
        T.StructField("po_date", T.DateType(), True),
        T.StructField("last_dttm", T.TimestampType(), True),
        T.StructField("buyer", T.StringType(), True),
        T.StructField("level_1", T.StringType(), True),
        T.StructField("level_2", T.StringType(), True),
        T.StructField("origin", T.StringType(), True),
        T.StructField("req_id", T.StringType(), True),
        T.StructField("bid_category", T.StringType(), True),
        T.StructField("vendor", T.StringType(), True),
        T.StructField("quote_link", T.StringType(), True),
    ]
)

PO_LINE_COLUMNS = [f.name for f in PO_LINE_SCHEMA.fields]

BID_SCHEMA = T.StructType([T.StructField("req_id", T.StringType(), True)])

# Header names of the two ERP sheet layouts, mapped to the
# canonical names. Layout "cube" is the five-section script's extract
# (business unit column spelled "Bussiness_Unit"), layout "working" the
# later single extract ("Unit", "Vendor").
SHEET_LAYOUTS: dict[str, dict[str, str]] = {
    "cube": {
        "PO No.": "po_no",
        "Bussiness_Unit": "unit",
        "Status": "status",
        "Sum Amount": "sum_amount",
        "PO Date": "po_date",
        "Last Dttm": "last_dttm",
        "Buyer": "buyer",
        "Level 1": "level_1",
        "Level 2": "level_2",
        "Origin": "origin",
        "Req ID": "req_id",
        "Bid Category": "bid_category",
        "Vendor_Name": "vendor",
        "QuoteLink": "quote_link",
    },
    "working": {
        "PO No.": "po_no",
        "Unit": "unit",
        "Status": "status",
        "Sum Amount": "sum_amount",
        "PO Date": "po_date",
        "Last Dttm": "last_dttm",
        "Buyer": "buyer",
        "Level 1": "level_1",
        "Level 2": "level_2",
        "Origin": "origin",
        "Req ID": "req_id",
        "Bid Category": "bid_category",
        "Vendor": "vendor",
        "QuoteLink": "quote_link",
    },
}


def canonical_to_sheet(layout: str = "working") -> dict[str, str]:
    """Inverse map: canonical name -> sheet header of ``layout``."""
    return {v: k for k, v in SHEET_LAYOUTS[layout].items()}
