"""Column expressions with R's NULL rules, all built from Catalyst
built-ins (no Python UDF), so they stay inside whole-stage codegen."""

from spendlens.functions.conditional import if_else, case_when
from spendlens.functions.membership import is_member, not_member
from spendlens.functions.aggregates import strict_sum, first_value_by
from spendlens.functions.dates import (
    months_before,
    years_before,
    fiscal_year_start,
    in_period,
    month_label,
)
from spendlens.functions.text import glue, starts_with_na, money_text, count_text
from spendlens.functions.ordering import level_rank

__all__ = [
    "if_else",
    "case_when",
    "is_member",
    "not_member",
    "strict_sum",
    "first_value_by",
    "months_before",
    "years_before",
    "fiscal_year_start",
    "in_period",
    "month_label",
    "glue",
    "starts_with_na",
    "money_text",
    "count_text",
    "level_rank",
]
