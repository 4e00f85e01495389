"""Independent SQL oracle (DuckDB dialect) for every registered query.

Written as plain SQL over the raw test tables, separately from the Spark
code: first rows use ``row_number()`` over the binding's six-column row
order (``ord``), not the Spark side's ``line_id`` encoding; NULL-safe
matches use ``IS NOT DISTINCT FROM``. Parameter values come from the same
``SpendParams`` object so both sides use one set of lists and limits.
"""

from __future__ import annotations

from spendlens.params import DEFAULT_PARAMS as P


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def _d(d) -> str:
    return f"DATE '{d.isoformat()}'"


EXCL = _in(P.excluded_statuses)
STATUS_OK = f"status NOT IN {EXCL}"
A_START, A_END = _d(P.period_a.start), _d(P.period_a.end)
B_START, B_END = _d(P.period_b.start), _d(P.period_b.end)

BINDING = """
po_lines AS (
  SELECT
    row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
                                l.l_extendedprice, l.l_shipdate) AS ord,
    l.l_orderkey AS po_no,
    n.n_name AS unit,
    o.o_orderstatus AS status,
    CASE
      WHEN l.l_linenumber = 7 AND l.l_returnflag = 'A' THEN NULL
      WHEN l.l_linenumber = 6 AND l.l_returnflag = 'R'
        THEN -CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.1 AS DECIMAL(18,3))
      ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.1 AS DECIMAL(18,3))
    END AS sum_amount,
    CAST(o.o_orderdate AS DATE) AS po_date,
    CAST(o.o_orderdate AS DATE) + CAST(l.l_linenumber AS INTEGER) AS last_day,
    CASE WHEN c.c_nationkey = 24 THEN NULL ELSE 'B' || CAST(c.c_nationkey AS VARCHAR) END AS buyer,
    CASE
      WHEN starts_with(p.p_name, 'small') THEN 'L1A'
      WHEN starts_with(p.p_name, 'red') THEN 'L1_' || CAST(p.p_partkey % 2 AS VARCHAR)
      WHEN starts_with(p.p_name, 'blue') THEN 'L1_' || CAST(p.p_partkey % 3 AS VARCHAR)
      ELSE 'L1B'
    END AS level_1,
    p.p_name AS level_2,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'SWC' WHEN '5-LOW' THEN NULL ELSE 'PUR' END AS origin,
    CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(l.l_partkey AS VARCHAR) END AS req_id,
    p.p_brand AS bid_category,
    s.s_name AS vendor,
    CASE l.l_returnflag
      WHEN 'R' THEN 'http://quote/' || CAST(l.l_partkey AS VARCHAR)
      WHEN 'A' THEN NULL
      ELSE 'none'
    END AS quote_link
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
bids17 AS (SELECT CAST(p_partkey AS VARCHAR) AS req_id FROM part WHERE p_size <= 3),
bids18 AS (
  SELECT CAST(p_partkey AS VARCHAR) AS req_id FROM part WHERE p_size BETWEEN 3 AND 6
  UNION ALL SELECT CAST(NULL AS VARCHAR)
),
bid_set AS (SELECT DISTINCT req_id FROM (SELECT * FROM bids17 UNION ALL SELECT * FROM bids18))
"""

# The lines with NULL keys.
NULLED = """
nulled AS (
  SELECT * REPLACE (CASE WHEN po_no % 7 <> 0 THEN po_no END AS po_no,
                    CASE WHEN NOT ends_with(vendor, '3') THEN vendor END AS vendor,
                    CASE WHEN NOT ends_with(unit, '3') THEN unit END AS unit)
  FROM po_lines
)"""

LINE_COLS = (
    "po_no, unit, status, CAST(sum_amount AS DOUBLE) AS sum_amount, po_date, buyer, level_1, "
    "level_2, origin, req_id, bid_category, vendor, quote_link"
)

PLATFORM_CASE = f"""
  CASE
    WHEN origin IS NULL THEN 'Uncategorized'
    WHEN origin = {_lit(P.swc_origin)} THEN 'Commbuys'
    WHEN in_bid_log THEN 'Business Center'
    WHEN quote_link IS NULL THEN 'Uncategorized'
    WHEN starts_with(quote_link, {_lit(P.quote_prefix)}) THEN 'FairMarkIt'
    ELSE 'Uncategorized'
  END"""

BUYER_TYPE_CASE = f"""
  CASE
    WHEN origin IS NULL THEN NULL
    WHEN origin = {_lit(P.swc_origin)} THEN 'SWC Buyer'
    WHEN buyer IN {_in(P.type_sourcing_execs)} THEN 'Sourcing Executive'
    WHEN buyer IN {_in(P.type_non_inventory)} THEN 'Non-Inventory'
    WHEN buyer IN {_in(P.type_inventory)} THEN 'Inventory'
    ELSE 'NA'
  END"""

BUYER_CLASS_CASE = f"""
  CASE
    WHEN buyer IN {_in(P.class_sourcing_execs)} THEN 'Sourcing Executive'
    WHEN buyer IN {_in(P.class_non_inventory)} THEN 'Non-Inventory Buyer'
    WHEN buyer IN {_in(P.class_inventory)} THEN 'Inventory Buyer'
    WHEN buyer IS NOT NULL THEN 'Buyer Outside P&L'
    ELSE 'ERROR'
  END"""

# One row per PO: total over all lines + first line (row order) + platform.
PO_CTES = f"""
po_amt AS (SELECT po_no, SUM(sum_amount) AS amt FROM po_lines GROUP BY po_no),
po_first AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY po_no ORDER BY ord) AS rn FROM po_lines
  ) WHERE rn = 1
),
po_base AS (
  SELECT f.po_no, a.amt, f.buyer, f.unit, f.origin, f.req_id, f.vendor, f.quote_link,
         f.po_date, f.ord AS first_ord,
         EXISTS (SELECT 1 FROM bid_set b WHERE b.req_id IS NOT DISTINCT FROM f.req_id) AS in_bid_log
  FROM po_first f JOIN po_amt a ON f.po_no IS NOT DISTINCT FROM a.po_no
),
po AS (SELECT *, {PLATFORM_CASE} AS platform, {BUYER_TYPE_CASE} AS buyer_type FROM po_base)
"""

TAXO_CTE = f"""
taxo_dups AS (
  SELECT level_2, COUNT(*) AS n_parents
  FROM (SELECT DISTINCT level_1, level_2 FROM po_lines)
  GROUP BY level_2 HAVING COUNT(*) = {P.taxonomy_parents}
)
"""

UNIT_CTES = f"""
clean AS (SELECT * FROM po_lines WHERE {STATUS_OK}),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY po_no ORDER BY ord) rn FROM clean) WHERE rn = 1
),
a_clean AS (SELECT * FROM clean WHERE po_date >= {A_START} AND po_date < {A_END}),
a_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY po_no ORDER BY ord) rn FROM a_clean) WHERE rn = 1
),
b_clean AS (SELECT * FROM clean WHERE po_date >= {B_START} AND po_date < {B_END}),
b_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY po_no ORDER BY ord) rn FROM b_clean) WHERE rn = 1
),
ytd_amt AS (SELECT unit, SUM(sum_amount) AS year_spend FROM clean GROUP BY unit),
year_pos AS (SELECT unit, COUNT(*) AS year_pos FROM firsts GROUP BY unit),
a_amt AS (SELECT unit, SUM(sum_amount) AS period_a_spend FROM a_clean GROUP BY unit),
a_cnt AS (SELECT unit, COUNT(*) AS period_a_pos FROM a_first GROUP BY unit),
b_amt AS (SELECT unit, SUM(sum_amount) AS period_b_spend FROM b_clean GROUP BY unit),
b_cnt AS (SELECT unit, COUNT(*) AS period_b_pos FROM b_first GROUP BY unit),
joined AS (
  SELECT y.unit, y.year_spend, yc.year_pos, a.period_a_spend, ac.period_a_pos,
         b.period_b_spend, bc.period_b_pos
  FROM ytd_amt y
  LEFT JOIN year_pos yc ON y.unit IS NOT DISTINCT FROM yc.unit
  LEFT JOIN a_amt a ON y.unit IS NOT DISTINCT FROM a.unit
  LEFT JOIN a_cnt ac ON y.unit IS NOT DISTINCT FROM ac.unit
  LEFT JOIN b_amt b ON y.unit IS NOT DISTINCT FROM b.unit
  LEFT JOIN b_cnt bc ON y.unit IS NOT DISTINCT FROM bc.unit
),
filled AS (
  SELECT unit,
         COALESCE(year_spend, 0) AS year_spend, COALESCE(year_pos, 0) AS year_pos,
         COALESCE(period_a_spend, 0) AS period_a_spend, COALESCE(period_a_pos, 0) AS period_a_pos,
         COALESCE(period_b_spend, 0) AS period_b_spend, COALESCE(period_b_pos, 0) AS period_b_pos
  FROM joined
),
with_total AS (
  SELECT unit, year_spend, year_pos, period_a_spend, period_a_pos, period_b_spend, period_b_pos,
         false AS is_total
  FROM filled
  UNION ALL
  SELECT 'Total', SUM(year_spend), SUM(year_pos), SUM(period_a_spend), SUM(period_a_pos),
         SUM(period_b_spend), SUM(period_b_pos), true
  FROM filled
)
"""

BIN_CTES = f"""
po_tot AS (
  SELECT po_no, SUM(sum_amount) AS t FROM po_lines
  WHERE sum_amount >= 0 AND po_no IS NOT NULL AND {STATUS_OK}
  GROUP BY po_no
)
"""

VENDOR_CTES = f"""
vlines AS (
  SELECT * FROM po_lines
  WHERE NOT COALESCE(buyer IN {_in(P.vendor_excluded_buyers)}, false) AND unit = {_lit(P.vendor_unit)}
),
vnum AS (SELECT vendor, COUNT(*) AS num_pos FROM (SELECT DISTINCT po_no, vendor FROM vlines) GROUP BY vendor),
vtot AS (SELECT vendor, SUM(sum_amount) AS tot FROM vlines GROUP BY vendor),
vjoin AS (
  SELECT n.vendor, n.num_pos, CAST(t.tot AS DOUBLE) AS vendor_total,
         CAST(t.tot AS DOUBLE) / CAST(1000000 AS DOUBLE) AS vendor_total_mm
  FROM vnum n LEFT JOIN vtot t ON n.vendor IS NOT DISTINCT FROM t.vendor
),
vranked AS (
  SELECT vendor, CAST(num_pos AS BIGINT) AS num_pos, vendor_total, vendor_total_mm,
         row_number() OVER (ORDER BY vendor_total DESC NULLS LAST, vendor ASC NULLS LAST) AS vendor_rank
  FROM vjoin
)
"""

ALL_VENDOR_TOTALS = """
avt AS (SELECT vendor, CAST(SUM(sum_amount) AS DOUBLE) AS vendor_total FROM po_lines GROUP BY vendor)
"""

ASOF = "(SELECT MAX(last_day) FROM po_lines)"


def _q(ctes: str, final: str) -> str:
    parts = [BINDING.strip()]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + final.strip()


def _money_text(x: str) -> str:
    txt = f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"
    return f"'$' || lpad({txt}, CAST(MAX(length({txt})) OVER () AS INTEGER), ' ')"


def _count_text(x: str) -> str:
    txt = f"format('{{:,}}', CAST({x} AS BIGINT))"
    return f"lpad({txt}, CAST(MAX(length({txt})) OVER () AS INTEGER), ' ')"


def _first_lines(src: str = "po_lines") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY po_no ORDER BY ord) rn FROM {src}) WHERE rn = 1)"


ORACLE: dict[str, str] = {
    # ---------------------------------------------------------- sources
    "src_po_lines": _q("", f"SELECT {LINE_COLS} FROM po_lines"),
    "src_bids": _q("", "SELECT '2017' AS sheet, req_id FROM bids17 UNION ALL SELECT '2018', req_id FROM bids18"),
    # ---------------------------------------------------------- sinks
    "sink_csv": _q(
        VENDOR_CTES,
        """SELECT vendor, CAST(num_pos AS VARCHAR) AS num_pos, format('{:.15g}', vendor_total) AS vendor_total,
                  format('{:.15g}', vendor_total_mm) AS vendor_total_mm, CAST(vendor_rank AS VARCHAR) AS vendor_rank
           FROM vranked""",
    ),
    "sink_csv_numbered": _q(
        BIN_CTES + """,
        b AS (
          SELECT CASE WHEN t IS NULL THEN NULL WHEN t <= 3500 THEN 'Micro'
                      WHEN t > 3500 AND t < 50000 THEN 'Small'
                      WHEN t >= 50000 THEN 'Large' ELSE 'Other' END AS bin_level, t
          FROM po_tot),
        g AS (SELECT bin_level, COUNT(*) AS cnt, SUM(t) AS spend FROM b GROUP BY bin_level)""",
        """SELECT row_number() OVER (ORDER BY CASE bin_level WHEN 'Micro' THEN 1 WHEN 'Small' THEN 2
                                                   WHEN 'Large' THEN 3 END NULLS LAST) AS row_name,
                  bin_level, cnt, round(cnt / SUM(cnt) OVER () * 100, 10) AS pct_cnt,
                  round(CAST(spend AS DOUBLE), 10) AS spend,
                  round(CAST(spend AS DOUBLE) / CAST(SUM(spend) OVER () AS DOUBLE) * 100, 10) AS pct_spend
           FROM g""",
    ),
    # ---------------------------------------------------------- projections / filters
    "op_rename": _q(
        "",
        """SELECT po_no AS "PO No.", unit AS "Unit", status AS "Status",
                  CAST(sum_amount AS DOUBLE) AS "Sum Amount", po_date AS "PO Date", buyer AS "Buyer",
                  level_1 AS "Level 1", level_2 AS "Level 2", origin AS "Origin", req_id AS "Req ID",
                  bid_category AS "Bid Category", vendor AS "Vendor", quote_link AS "QuoteLink"
           FROM po_lines""",
    ),
    "op_status_exclude": _q("", f"SELECT {LINE_COLS} FROM po_lines WHERE {STATUS_OK}"),
    "op_status_cycle": _q(
        "",
        f"""SELECT {LINE_COLS} FROM po_lines
            WHERE status <> list_extract({_in(P.excluded_statuses).replace('(', '[').replace(')', ']')},
                                         CAST(((ord - 1) % {len(P.excluded_statuses)}) + 1 AS INTEGER))""",
    ),
    "op_amount_nonneg": _q("", f"SELECT {LINE_COLS} FROM po_lines WHERE sum_amount >= 0"),
    "op_has_po": _q(NULLED, f"SELECT {LINE_COLS} FROM nulled WHERE po_no IS NOT NULL"),
    "op_date_range": _q("", f"SELECT {LINE_COLS} FROM po_lines WHERE po_date >= {A_START} AND po_date < {A_END}"),
    "op_month_filter": _q("", f"SELECT {LINE_COLS} FROM po_lines WHERE month(po_date) = {P.report_months[0]}"),
    "op_member_include": _q(
        PO_CTES,
        f"""SELECT po_no, buyer, platform, 'non_inventory' AS subset FROM po WHERE buyer IN {_in(P.type_non_inventory)}
            UNION ALL
            SELECT po_no, buyer, platform, 'inventory' FROM po WHERE buyer IN {_in(P.type_inventory)}""",
    ),
    "op_member_exclude": _q(
        "", f"SELECT {LINE_COLS} FROM po_lines WHERE NOT COALESCE(buyer IN {_in(P.vendor_excluded_buyers)}, false)"
    ),
    "op_eq_filter": _q("", f"SELECT {LINE_COLS} FROM po_lines WHERE unit = {_lit(P.vendor_unit)}"),
    "op_complement": _q(
        PO_CTES,
        f"""SELECT po_no, buyer, platform,
                   CASE WHEN COALESCE(buyer IN {_in(P.type_sourcing_execs)}, false)
                        THEN 'sourcing_exec' ELSE 'other' END AS subset
            FROM po""",
    ),
    # ---------------------------------------------------------- joins
    "op_natural_left_join": _q(
        NULLED + f""",
        clean AS (SELECT * FROM nulled WHERE {STATUS_OK}),
        y AS (SELECT unit, SUM(sum_amount) AS year_spend FROM clean GROUP BY unit),
        a AS (SELECT unit, SUM(sum_amount) AS period_a_spend FROM clean
              WHERE po_date >= {A_START} AND po_date < {A_END} GROUP BY unit)""",
        """SELECT y.unit, CAST(y.year_spend AS DOUBLE) AS year_spend, CAST(a.period_a_spend AS DOUBLE) AS period_a_spend
           FROM y LEFT JOIN a ON y.unit IS NOT DISTINCT FROM a.unit""",
    ),
    "op_left_join_nullsafe": _q(
        NULLED + """,
        n AS (SELECT vendor, COUNT(*) AS num_pos FROM (SELECT DISTINCT po_no, vendor FROM nulled) GROUP BY vendor),
        t AS (SELECT vendor, CAST(SUM(sum_amount) AS DOUBLE) AS vendor_total FROM nulled GROUP BY vendor)""",
        """SELECT n.vendor, n.num_pos, t.vendor_total
           FROM n LEFT JOIN t ON n.vendor IS NOT DISTINCT FROM t.vendor""",
    ),
    "op_attach_po_total": _q(
        "",
        """SELECT po_no, CAST(sum_amount AS DOUBLE) AS sum_amount,
                  CAST(SUM(sum_amount) OVER (PARTITION BY po_no) AS DOUBLE) AS amt
           FROM po_lines""",
    ),
    "op_attach_unit_po_total": _q(
        "",
        f"""SELECT po_no, unit, CAST(sum_amount AS DOUBLE) AS sum_amount,
                   CAST(SUM(sum_amount) OVER (PARTITION BY unit, po_no) AS DOUBLE) AS po_total_amount
            FROM po_lines WHERE {STATUS_OK} AND sum_amount >= 0""",
    ),
    "op_exists_nullsafe": _q(
        "",
        """SELECT po_no, req_id,
                  EXISTS (SELECT 1 FROM bid_set b WHERE b.req_id IS NOT DISTINCT FROM l.req_id) AS in_bid_log
           FROM po_lines l""",
    ),
    "op_explicit_taxonomy": _q(
        TAXO_CTE,
        """SELECT po_no, level_1, level_2,
                  CASE WHEN EXISTS (SELECT 1 FROM taxo_dups d WHERE d.level_2 IS NOT DISTINCT FROM l.level_2)
                       THEN COALESCE(level_2, 'NA') || '_' || COALESCE(level_1, 'NA')
                       ELSE level_2 END AS explicit_taxonomy_2
           FROM po_lines l""",
    ),
    # ---------------------------------------------------------- aggregates
    "op_group_sum": _q("", "SELECT unit, CAST(SUM(sum_amount) AS DOUBLE) AS spend FROM po_lines GROUP BY unit"),
    "op_group_sum_strict": _q(
        "",
        """SELECT po_no,
                  CASE WHEN COUNT(*) = COUNT(sum_amount) THEN CAST(SUM(sum_amount) AS DOUBLE) END AS po_total_strict
           FROM po_lines GROUP BY po_no""",
    ),
    "op_group_count": _q("", "SELECT unit, COUNT(*) AS n_lines FROM po_lines GROUP BY unit"),
    "rpt_unit_po_total": _q(
        "",
        f"""SELECT unit, po_no, CAST(SUM(sum_amount) AS DOUBLE) AS po_total_amount
            FROM po_lines WHERE {STATUS_OK} AND sum_amount >= 0 GROUP BY unit, po_no""",
    ),
    "op_distinct_count_per_key": _q(
        NULLED, "SELECT vendor, COUNT(*) AS num_pos FROM (SELECT DISTINCT po_no, vendor FROM nulled) GROUP BY vendor"
    ),
    "op_first_attributed_count": _q(
        f"clean AS (SELECT * FROM po_lines WHERE {STATUS_OK})",
        f"SELECT unit, COUNT(*) AS po_count FROM {_first_lines('clean')} GROUP BY unit",
    ),
    "op_as_of_dates": _q(
        "as_of AS (SELECT MAX(last_day) AS d FROM po_lines)",
        f"""SELECT d AS as_of_date,
                   CAST(d - INTERVAL 1 MONTH AS DATE) AS last_month,
                   CAST(d - INTERVAL 2 MONTH AS DATE) AS two_months_ago,
                   make_date(CAST(year(d) - CASE WHEN month(d) < {P.fiscal_year_start_month} THEN 1 ELSE 0 END AS BIGINT),
                             {P.fiscal_year_start_month}, 1) AS fy_day_1,
                   CAST(d - INTERVAL 1 YEAR AS DATE) AS year_ago
            FROM as_of""",
    ),
    "op_totals_row": _q(
        "u AS (SELECT unit, SUM(sum_amount) AS spend, COUNT(*) AS n_lines FROM po_lines GROUP BY unit)",
        """SELECT unit, CAST(spend AS DOUBLE) AS spend, n_lines, false AS is_total FROM u
           UNION ALL
           SELECT 'Total', CAST(SUM(spend) AS DOUBLE), CAST(SUM(n_lines) AS BIGINT), true FROM u""",
    ),
    "op_pct_of_total": _q(
        f"u AS (SELECT unit, SUM(sum_amount) AS spend FROM po_lines WHERE {STATUS_OK} GROUP BY unit)",
        """SELECT unit, CAST(spend AS DOUBLE) AS spend,
                  CAST(spend AS DOUBLE) / CAST(SUM(spend) OVER () AS DOUBLE) * 100 AS pct_spend
           FROM u""",
    ),
    # ---------------------------------------------------------- distinct / first row
    "op_distinct_rows": _q(
        "",
        """SELECT DISTINCT po_no, CAST(SUM(sum_amount) OVER (PARTITION BY po_no) AS DOUBLE) AS amt, buyer, unit,
                  origin, req_id, vendor, quote_link, po_date
           FROM po_lines""",
    ),
    "op_distinct_cols": _q("", "SELECT DISTINCT level_1, level_2 FROM po_lines"),
    "op_first_per_key": _q(NULLED, f"SELECT {LINE_COLS} FROM {_first_lines('nulled')}"),
    # ---------------------------------------------------------- sorts
    "op_sort_asc": _q(
        ALL_VENDOR_TOTALS,
        """SELECT vendor, vendor_total,
                  row_number() OVER (ORDER BY vendor_total ASC NULLS LAST, vendor ASC NULLS LAST) AS pos
           FROM avt""",
    ),
    "op_sort_desc": _q(
        ALL_VENDOR_TOTALS,
        """SELECT vendor, vendor_total,
                  row_number() OVER (ORDER BY vendor_total DESC NULLS LAST, vendor ASC NULLS LAST) AS pos
           FROM avt""",
    ),
    # ---------------------------------------------------------- sets
    "op_union_all": _q("", "SELECT req_id FROM bids17 UNION ALL SELECT req_id FROM bids18"),
    "op_union_distinct": _q("", "SELECT DISTINCT req_id FROM (SELECT req_id FROM bids17 UNION ALL SELECT req_id FROM bids18)"),
    # ---------------------------------------------------------- scalar functions
    "op_if_else": _q(
        "",
        f"""SELECT po_no, origin,
                   CASE WHEN origin IS NULL THEN NULL WHEN origin = {_lit(P.swc_origin)} THEN 'Commbuys'
                        ELSE 'Other' END AS swc_flag
            FROM po_lines""",
    ),
    "op_buyer_class": _q("", f"SELECT po_no, buyer, {BUYER_CLASS_CASE} AS buyer_classification FROM po_lines"),
    "op_fill_zero": _q(
        UNIT_CTES,
        """SELECT unit, CAST(year_spend AS DOUBLE) AS year_spend, CAST(year_pos AS BIGINT) AS year_pos,
                  CAST(period_a_spend AS DOUBLE) AS period_a_spend, CAST(period_a_pos AS BIGINT) AS period_a_pos,
                  CAST(period_b_spend AS DOUBLE) AS period_b_spend, CAST(period_b_pos AS BIGINT) AS period_b_pos
           FROM filled""",
    ),
    "op_fill_label": _q(
        """lb AS (
          SELECT po_no, origin, quote_link,
                 EXISTS (SELECT 1 FROM bid_set b WHERE b.req_id IS NOT DISTINCT FROM l.req_id) AS in_bid_log
          FROM po_lines l)""",
        f"""SELECT po_no,
                   CASE WHEN origin IS NULL THEN NULL
                        WHEN origin = {_lit(P.swc_origin)} THEN 'Commbuys'
                        WHEN in_bid_log THEN 'Business Center'
                        WHEN quote_link IS NULL THEN NULL
                        WHEN starts_with(quote_link, {_lit(P.quote_prefix)}) THEN 'FairMarkIt'
                        ELSE 'Uncategorized' END AS platform_raw,
                   {PLATFORM_CASE} AS platform
            FROM lb""",
    ),
    "op_prefix_match": _q(
        "", f"SELECT po_no, quote_link, starts_with(quote_link, {_lit(P.quote_prefix)}) AS starts_h FROM po_lines"
    ),
    "op_format_money": _q(
        f"u AS (SELECT unit, SUM(sum_amount) AS spend FROM po_lines WHERE {STATUS_OK} GROUP BY unit)",
        f"SELECT unit, {_money_text('spend')} AS spend_text FROM u",
    ),
    "op_round_half_even": _q(
        f"u AS (SELECT unit, SUM(sum_amount) AS spend FROM po_lines WHERE {STATUS_OK} GROUP BY unit)",
        "SELECT unit, CAST(round_even(spend, 0) AS BIGINT) AS spend_rounded FROM u",
    ),
    "op_period_flags": _q(
        "",
        f"""SELECT po_no, po_date,
                   po_date > CAST({ASOF} - INTERVAL 1 MONTH AS DATE) AS in_last_1_month,
                   po_date > CAST({ASOF} - INTERVAL 2 MONTH AS DATE) AS in_last_2_months
            FROM po_lines""",
    ),
    "op_fiscal_year_start": _q(
        "",
        f"""SELECT po_no, po_date,
                   make_date(CAST(year(po_date) - CASE WHEN month(po_date) < {P.fiscal_year_start_month} THEN 1 ELSE 0 END AS BIGINT),
                             {P.fiscal_year_start_month}, 1) AS fiscal_year_start
            FROM po_lines""",
    ),
    # ---------------------------------------------------------- reports
    "rpt_clean_po_lines": _q(
        TAXO_CTE + f""",
        c AS (SELECT * FROM po_lines WHERE {STATUS_OK} AND sum_amount >= 0)""",
        f"""SELECT po_no, unit, status, CAST(sum_amount AS DOUBLE) AS sum_amount, po_date, buyer, level_1,
                   level_2, origin, req_id, vendor, quote_link,
                   po_date > CAST({ASOF} - INTERVAL 1 MONTH AS DATE) AS in_last_1_month,
                   po_date > CAST({ASOF} - INTERVAL 2 MONTH AS DATE) AS in_last_2_months,
                   CASE WHEN EXISTS (SELECT 1 FROM taxo_dups d WHERE d.level_2 IS NOT DISTINCT FROM c.level_2)
                        THEN COALESCE(level_2, 'NA') || '_' || COALESCE(level_1, 'NA')
                        ELSE level_2 END AS explicit_taxonomy_2,
                   {BUYER_CLASS_CASE} AS buyer_classification
            FROM c""",
    ),
    "rpt_taxonomy_duplicates": _q(TAXO_CTE, "SELECT level_2, n_parents FROM taxo_dups"),
    "rpt_po_lines_by_class": _q(
        f"c AS (SELECT *, {BUYER_CLASS_CASE} AS buyer_classification FROM po_lines WHERE {STATUS_OK} AND sum_amount >= 0)",
        "SELECT unit, po_no, buyer_classification, COUNT(*) AS po_line_count FROM c GROUP BY ALL",
    ),
    "rpt_unit_summary": _q(
        UNIT_CTES,
        """SELECT unit, CAST(year_spend AS DOUBLE) AS year_spend, CAST(year_pos AS BIGINT) AS year_pos,
                  CAST(period_a_spend AS DOUBLE) AS period_a_spend, CAST(period_a_pos AS BIGINT) AS period_a_pos,
                  CAST(period_b_spend AS DOUBLE) AS period_b_spend, CAST(period_b_pos AS BIGINT) AS period_b_pos,
                  is_total
           FROM with_total""",
    ),
    "rpt_unit_summary_display": _q(
        UNIT_CTES,
        f"""SELECT unit,
                   {_money_text('year_spend')} AS "Total Spend",
                   {_count_text('year_pos')} AS "Total No. of POs",
                   {_money_text('period_a_spend')} AS "Spend in April",
                   {_count_text('period_a_pos')} AS "No. of POs in April",
                   {_money_text('period_b_spend')} AS "Spend in May",
                   {_count_text('period_b_pos')} AS "No. of POs in May"
            FROM with_total""",
    ),
    "rpt_spend_bin_flag": _q(
        BIN_CTES,
        "SELECT t >= 50000 AS under_equal_50k, COUNT(*) AS cnt, CAST(SUM(t) AS DOUBLE) AS spend FROM po_tot GROUP BY 1",
    ),
    "rpt_spend_bins": _q(
        BIN_CTES + """,
        b AS (
          SELECT CASE WHEN t IS NULL THEN NULL WHEN t <= 3500 THEN 'Micro'
                      WHEN t > 3500 AND t < 50000 THEN 'Small'
                      WHEN t >= 50000 THEN 'Large' ELSE 'Other' END AS bin_level, t
          FROM po_tot),
        g AS (SELECT bin_level, COUNT(*) AS cnt, SUM(t) AS spend FROM b GROUP BY bin_level)""",
        """SELECT bin_level, cnt, cnt / SUM(cnt) OVER () * 100 AS pct_cnt, CAST(spend AS DOUBLE) AS spend,
                  CAST(spend AS DOUBLE) / CAST(SUM(spend) OVER () AS DOUBLE) * 100 AS pct_spend
           FROM g""",
    ),
    "rpt_spend_bins_positional": _q(
        f"""kept AS (
          SELECT * FROM po_lines
          WHERE status <> list_extract({_in(P.excluded_statuses).replace('(', '[').replace(')', ']')},
                                       CAST(((ord - 1) % {len(P.excluded_statuses)}) + 1 AS INTEGER))),
        t AS (SELECT po_no, SUM(sum_amount) AS t FROM kept WHERE sum_amount >= 0 AND po_no IS NOT NULL GROUP BY po_no),
        b AS (SELECT CASE WHEN t <= {P.micro_max} THEN 'Micro' WHEN t < {P.large_min} THEN 'Small'
                          WHEN t >= {P.large_min} THEN 'Large' END AS bin_level, t FROM t),
        g AS (SELECT bin_level, COUNT(*) AS cnt, SUM(t) AS spend FROM b GROUP BY bin_level)""",
        """SELECT bin_level, cnt, cnt / SUM(cnt) OVER () * 100 AS pct_cnt, CAST(spend AS DOUBLE) AS spend,
                  CAST(spend AS DOUBLE) / CAST(SUM(spend) OVER () AS DOUBLE) * 100 AS pct_spend
           FROM g""",
    ),
    "rpt_month_files": _q(
        PO_CTES,
        " UNION ALL ".join(
            f"""SELECT {m} AS month, '{key}' AS grouped_by, {key} AS label, COUNT(*) AS qty_of_pos,
                       CAST(SUM(amt) AS DOUBLE) AS total_spend
                FROM po WHERE month(po_date) = {m} GROUP BY {key}"""
            for m in P.report_months
            for key in ("platform", "buyer_type")
        ),
    ),
    "rpt_po_platform": _q(
        PO_CTES,
        """SELECT po_no, CAST(amt AS DOUBLE) AS amt, buyer, unit, origin, req_id, vendor, quote_link, po_date, platform
           FROM po""",
    ),
    "rpt_platform_summary": _q(
        PO_CTES,
        "SELECT platform, COUNT(*) AS qty_of_pos, CAST(SUM(amt) AS DOUBLE) AS total_spend FROM po GROUP BY platform",
    ),
    "rpt_uncategorized_size": _q(
        PO_CTES,
        f"""SELECT CASE WHEN amt IS NULL THEN NULL WHEN amt < {P.size_split} THEN '<50,000' ELSE '50,000+' END AS size,
                   COUNT(*) AS qty_of_pos
            FROM po WHERE platform = 'Uncategorized' GROUP BY 1""",
    ),
    "rpt_buyer_type": _q(
        PO_CTES,
        "SELECT buyer_type, COUNT(*) AS qty_of_pos, CAST(SUM(amt) AS DOUBLE) AS total_spend FROM po GROUP BY buyer_type",
    ),
    "rpt_vendors_by_platform": _q(
        PO_CTES + """,
        vfirst AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY first_ord) rn FROM po) WHERE rn = 1
        ),
        v AS (SELECT platform, COUNT(*) AS qty_of_vendors FROM vfirst GROUP BY platform),
        pp AS (SELECT platform, COUNT(*) AS qty_of_pos FROM po GROUP BY platform)""",
        """SELECT v.platform, v.qty_of_vendors, pp.qty_of_pos
           FROM v LEFT JOIN pp ON v.platform IS NOT DISTINCT FROM pp.platform""",
    ),
    "rpt_month_platform": _q(
        PO_CTES,
        f"""SELECT strftime(po_date, '%b') AS month, platform, COUNT(*) AS qty_of_pos,
                   CAST(SUM(amt) AS DOUBLE) AS total_spend
            FROM po WHERE month(po_date) IN {_in(P.report_months)} GROUP BY 1, 2""",
    ),
    "rpt_month_buyer_type": _q(
        PO_CTES,
        f"""SELECT strftime(po_date, '%b') AS month, buyer_type, COUNT(*) AS qty_of_pos,
                   CAST(SUM(amt) AS DOUBLE) AS total_spend
            FROM po WHERE month(po_date) IN {_in(P.report_months)} GROUP BY 1, 2""",
    ),
    "rpt_po_extract": _q(
        PO_CTES, "SELECT platform, po_no, CAST(amt AS DOUBLE) AS amt, buyer, origin, unit, vendor FROM po"
    ),
    "rpt_platform_under_limit": _q(
        PO_CTES,
        f"""SELECT platform, COUNT(*) AS qty_of_pos, CAST(SUM(amt) AS DOUBLE) AS total_spend
            FROM po WHERE amt <= {P.small_po_max} AND NOT COALESCE(po_no IN {_in(P.po_blacklist)}, false)
            GROUP BY platform""",
    ),
    "rpt_vendor_totals": _q(VENDOR_CTES, "SELECT * FROM vranked"),
    "rpt_top_vendors": _q(VENDOR_CTES, f"SELECT * FROM vranked WHERE vendor_total_mm >= {P.vendor_min_total_mm}"),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
