"""Structured Streaming entry points.

The reference processes finished workbooks only (no stream, watermark or
stateful operator); the one streaming piece here is the incremental landing
of new extract files into the Parquet table the reports read.
"""

from spendlens.streaming.landing import land_po_lines, land_po_lines_csv

__all__ = ["land_po_lines", "land_po_lines_csv"]
