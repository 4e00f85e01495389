"""Classification rules as Column expressions; lists and limits come from
``SpendParams``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens import labels as L
from spendlens.functions.conditional import case_when, if_else
from spendlens.functions.membership import is_member
from spendlens.functions.text import glue, starts_with_na
from spendlens.params import SpendParams


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def platform(origin, in_bid_log, quote_link, p: SpendParams) -> Column:
    """Sourcing platform of a PO line.

    Nested ``if_else`` (a NULL test gives NULL, it does not fall through),
    then NULL -> "Uncategorized". So a NULL origin is Uncategorized even if
    the requisition is in the bid log, and a NULL quote link is
    Uncategorized. ``in_bid_log`` is never NULL (``%in%``).
    """
    inner = if_else(
        _c(origin) == F.lit(p.swc_origin),
        L.PLATFORM_SWC,
        if_else(
            _c(in_bid_log),
            L.PLATFORM_BID_LOG,
            if_else(starts_with_na(quote_link, p.quote_prefix), L.PLATFORM_QUOTE, L.PLATFORM_NONE),
        ),
    )
    return F.coalesce(inner, F.lit(L.PLATFORM_NONE))


def buyer_type(origin, buyer, p: SpendParams) -> Column:
    """Buyer type of a PO: SWC origin, then the three lists in order, else
    the text "NA". A NULL origin gives a real NULL (two groups that print
    alike, kept apart)."""
    b = _c(buyer)
    return if_else(
        _c(origin) == F.lit(p.swc_origin),
        L.TYPE_SWC,
        if_else(
            is_member(b, p.type_sourcing_execs),
            L.TYPE_SOURCING_EXEC,
            if_else(
                is_member(b, p.type_non_inventory),
                L.TYPE_NON_INVENTORY,
                if_else(is_member(b, p.type_inventory), L.TYPE_INVENTORY, L.TYPE_NONE),
            ),
        ),
    )


def buyer_class(buyer, p: SpendParams) -> Column:
    """Buyer class of a cleaned line (``case_when``: first match wins).
    A known buyer in none of the lists is "Buyer Outside P&L"; a missing
    buyer is "ERROR"."""
    b = _c(buyer)
    return case_when(
        (is_member(b, p.class_sourcing_execs), L.CLASS_SOURCING_EXEC),
        (is_member(b, p.class_non_inventory), L.CLASS_NON_INVENTORY),
        (is_member(b, p.class_inventory), L.CLASS_INVENTORY),
        (b.isNotNull(), L.CLASS_OUTSIDE),
        default=L.CLASS_ERROR,
    )


def spend_bin(total, p: SpendParams) -> Column:
    """Micro <= micro_max < Small < large_min <= Large (base ``ifelse``:
    NULL total -> NULL)."""
    t = _c(total)
    return if_else(
        t <= p.micro_max,
        L.BIN_LEVELS[0],
        if_else(
            (t > p.micro_max) & (t < p.large_min),
            L.BIN_LEVELS[1],
            if_else(t >= p.large_min, L.BIN_LEVELS[2], L.BIN_OTHER),
        ),
    )


def size_label(total, p: SpendParams) -> Column:
    return if_else(_c(total) < p.size_split, L.SIZE_UNDER, L.SIZE_OVER)


def explicit_taxonomy(level_1, level_2, is_duplicate) -> Column:
    """``level_2`` with ``_level_1`` appended where ``level_2`` has several
    parents (``is_duplicate`` is never NULL)."""
    return F.when(_c(is_duplicate), glue(_c(level_2), "_", _c(level_1))).otherwise(_c(level_2))
