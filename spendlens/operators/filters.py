"""Row filters. Each is a ``DataFrame -> DataFrame`` step for
``df.transform``; all are plain Catalyst predicates, so they reach the
Parquet scan as pushed filters where the source allows it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.dates import in_period
from spendlens.functions.membership import is_member, not_member
from spendlens.operators.ordering import global_row_number, positions_from_groups


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def exclude_statuses(df: DataFrame, excluded: Iterable[str], col: str = "status") -> DataFrame:
    """Drop lines whose status is one of ``excluded``. A NULL status is
    dropped too, as ``status != x`` is NA for it."""
    return df.where(~_c(col).isin(list(excluded)))


def exclude_statuses_positional(
    df: DataFrame,
    excluded: Sequence[str],
    order_by: Sequence[str | Column],
    col: str = "status",
    group_bits: int | None = None,
) -> DataFrame:
    """The status test as written: the list of codes is repeated down the
    rows, so row *i* (1-based, in input order) is compared with code number
    (i - 1) mod n only.

    Needs a dense row number over the whole input in ``order_by`` order,
    computed with a distributed sort (no single-partition window). When the
    single ``order_by`` column is a ``line_id`` built as group * 2^bits +
    dense index (``group_bits``: 20 for the test binding), positions come
    from per-group counts instead, without sorting the lines; and when that
    column is dense itself (``group_bits=0``: Parquet extracts, numbered from
    their files' row counts), it is the position and the test a plain row
    predicate. Dense ids are checked first (``require_dense``).
    """
    vals = list(excluded)
    if group_bits == 0 and len(order_by) == 1 and isinstance(order_by[0], str):
        require_dense(df, order_by[0])
        numbered = df.withColumn("_pos_rn", F.col(order_by[0]))
    elif group_bits is not None and len(order_by) == 1 and isinstance(order_by[0], str):
        numbered = positions_from_groups(df, order_by[0], group_bits, "_pos_rn")
    else:
        numbered = global_row_number(df, order_by, "_pos_rn")
    cycle = F.element_at(
        F.array(*[F.lit(v) for v in vals]),
        (F.pmod(F.col("_pos_rn") - 1, F.lit(len(vals))) + 1).cast("int"),
    )
    return numbered.where(_c(col) != cycle).drop("_pos_rn")


def require_dense(df: DataFrame, col: str) -> None:
    """Raise unless ``col`` holds 1..n once each, as far as its count, least
    and largest value and their sum tell (one narrow aggregate)."""
    c = F.col(col)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("k"), F.min(c).alias("a"), F.max(c).alias("b"), F.sum(c.cast("decimal(20,0)")).alias("s")).first()
    if r.n and (r.k, r.a, r.b, r.s) != (r.n, 1, r.n, r.n * (r.n + 1) // 2):
        raise ValueError(f"{col} is not 1..{r.n}: number the rows, or leave line_ids unset")


def status_filter(df: DataFrame, p) -> DataFrame:
    """The status exclusion of ``SpendParams`` ``p`` (``p.status_rule``)."""
    if p.status_rule == "positional":
        bits = 0 if p.line_ids == "dense" else p.line_ids
        return exclude_statuses_positional(df, p.excluded_statuses, ["line_id"], group_bits=bits)
    return exclude_statuses(df, p.excluded_statuses)


def amount_nonneg(df: DataFrame, col: str = "sum_amount") -> DataFrame:
    """Keep amounts >= 0; NULL and negative lines are dropped."""
    return df.where(_c(col) >= 0)


def not_null(df: DataFrame, col: str = "po_no") -> DataFrame:
    return df.where(_c(col).isNotNull())


def date_range(
    df: DataFrame, col: str, start: dt.date, end: dt.date, fiscal_start_month: int = 7
) -> DataFrame:
    """Half-open ``[start, end)`` on a date column. On a table landed with a
    ``fiscal_year`` partition column the implied fiscal-year bounds are added
    as a partition filter, so only the matching folders are listed and read."""
    cond = in_period(col, start, end)
    if col == "po_date" and "fiscal_year" in df.columns:
        last = end - dt.timedelta(days=1)

        def fy(d: dt.date) -> int:
            return d.year - (1 if d.month < fiscal_start_month else 0)

        cond = cond & F.col("fiscal_year").between(fy(start), fy(last))
    return df.where(cond)


def covered(df: DataFrame, p) -> DataFrame:
    """The lines of ``p.year`` (all without one); on landed lines a partition filter too."""
    return df if p.year is None else date_range(df, "po_date", p.year.start, p.year.end, p.fiscal_year_start_month)


def month_in(df: DataFrame, col: str, months: Iterable[int]) -> DataFrame:
    """Calendar month of ``col`` in ``months``, any year."""
    return df.where(F.month(_c(col)).isin(list(months)))


def keep_members(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose value is one of ``values``; NULL is dropped unless listed."""
    return df.where(is_member(col, values))


def drop_members(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose value is none of ``values``; NULL is kept unless listed."""
    return df.where(not_member(col, values))


def split_members(df: DataFrame, col: str, values: Iterable) -> tuple[DataFrame, DataFrame]:
    """The rows with one of ``values`` and all others (NULL among them);
    together they are the input."""
    vals = list(values)
    return keep_members(df, col, vals), drop_members(df, col, vals)


def equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(_c(col) == F.lit(value))
