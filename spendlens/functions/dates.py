"""Calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def months_before(d, n: int) -> Column:
    """``d - months(n)``. Spark clamps a missing day to the month end
    (31 Mar - 1 month = 28/29 Feb) where lubridate gives NA."""
    return F.add_months(_c(d), -n)


def years_before(d, n: int = 1) -> Column:
    return F.add_months(_c(d), -12 * n)


def fiscal_year_start(d, start_month: int = 7) -> Column:
    """First day of the fiscal year containing ``d`` (year starts on the
    first of ``start_month``)."""
    d = _c(d)
    year = F.year(d) - F.when(F.month(d) < start_month, 1).otherwise(0)
    return F.make_date(year, F.lit(start_month), F.lit(1))


def in_period(d, start: dt.date, end: dt.date) -> Column:
    """Half-open ``[start, end)``; a literal-bound range the Parquet reader
    can use for row-group skipping."""
    d = _c(d)
    return (d >= F.lit(start)) & (d < F.lit(end))


def month_label(d) -> Column:
    """Three-letter English month name (``Apr``)."""
    return F.date_format(_c(d), "MMM")
