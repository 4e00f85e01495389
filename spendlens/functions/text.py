"""String helpers with R's printing rules."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from spendlens.labels import NA_TEXT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def glue(*parts) -> Column:
    """``str_glue``: literal strings and columns concatenated, a NULL
    column printed as ``NA`` (``concat`` would give NULL, ``concat_ws``
    would skip it)."""
    cols = []
    for p in parts:
        if isinstance(p, Column):
            cols.append(F.coalesce(p.cast("string"), F.lit(NA_TEXT)))
        else:
            cols.append(F.lit(str(p)))
    return F.concat(*cols)


def starts_with_na(col, prefix: str) -> Column:
    """Whether a text begins with ``prefix``: NULL for a NULL input."""
    return F.startswith(_c(col), F.lit(prefix))


def _grouped_text(value) -> Column:
    # R's round(x, 0) is half-to-even; format_number then adds the commas.
    return F.format_number(F.bround(_c(value), 0), 0)


def count_text(value) -> Column:
    """Counts of one report column as text: rounded to whole numbers, commas
    between thousands, every value left-padded to the widest one. The width is a window over the
    whole (report-sized) table; use only on finished reports."""
    txt = _grouped_text(value)
    width = F.max(F.length(txt)).over(Window.partitionBy())
    return F.lpad(txt, width, " ")


def money_text(value) -> Column:
    """As ``count_text``, with a dollar sign before the padded number."""
    return F.concat(F.lit("$"), count_text(value))
