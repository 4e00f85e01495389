"""DataFrame -> DataFrame operators (use with ``df.transform``)."""

from spendlens.operators.filters import (
    exclude_statuses,
    exclude_statuses_positional,
    amount_nonneg,
    not_null,
    date_range,
    month_in,
    keep_members,
    drop_members,
    split_members,
    equals,
)
from spendlens.operators.dedupe import first_per_key, distinct_rows, distinct_cols
from spendlens.operators.totals import (
    group_sum,
    group_count,
    attach_group_total,
    pct_of_total,
    with_totals_row,
)
from spendlens.operators.joins import join_nullsafe, natural_left_join, flag_exists, broadcast_if_small
from spendlens.operators.sets import union_all, union_distinct
from spendlens.operators.ordering import global_row_number, sort_report

__all__ = [
    "exclude_statuses",
    "exclude_statuses_positional",
    "amount_nonneg",
    "not_null",
    "date_range",
    "month_in",
    "keep_members",
    "drop_members",
    "split_members",
    "equals",
    "first_per_key",
    "distinct_rows",
    "distinct_cols",
    "group_sum",
    "group_count",
    "attach_group_total",
    "pct_of_total",
    "with_totals_row",
    "join_nullsafe",
    "natural_left_join",
    "flag_exists",
    "broadcast_if_small",
    "union_all",
    "union_distinct",
    "global_row_number",
    "sort_report",
]
