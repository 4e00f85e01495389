"""Conditionals.

``if_else`` follows R's ``if_else``/``ifelse``: a NULL test yields NULL
instead of falling through to the else branch (Spark's ``when`` treats a
NULL test as false). ``case_when`` follows dplyr's ``case_when``: a NULL test
is false, so it is plain ``when`` chaining.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def if_else(cond: Column, yes, no) -> Column:
    """R ``if_else(cond, yes, no)``: NULL ``cond`` -> NULL."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, _col(yes)).otherwise(_col(no))


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """dplyr ``case_when``: first TRUE branch wins, NULL tests are false."""
    if not branches:
        return _col(default)
    expr = F.when(branches[0][0], _col(branches[0][1]))
    for cond, value in branches[1:]:
        expr = expr.when(cond, _col(value))
    return expr.otherwise(_col(default))
