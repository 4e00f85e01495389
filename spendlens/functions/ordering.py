"""Custom level orders (R factors)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_rank(col, levels: Sequence[str]) -> Column:
    """1-based position of ``col`` in ``levels``; NULL for a value outside
    the levels (a factor turns it into NA, which sorts last).

    ``array_position`` returns 0 when absent, hence ``nullif``.
    """
    c = F.col(col) if isinstance(col, str) else col
    arr = F.array(*[F.lit(v) for v in levels])
    return F.nullif(F.array_position(arr, c), F.lit(0)).cast("int")
