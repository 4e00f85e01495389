"""Test binding: canonical PO lines and bid logs made from the driver's
TPC-H-style tables (``FIXTURES.md`` section C).

One PO line per ``lineitem`` row, inner-joined to its order, customer,
supplier (+ nation) and part. The join strategy is left to the planner:
at small scale the dimension sides are broadcast by the size check; at
large scale the joins are sort-merge joins ordered so the lines end up
partitioned by the order key, which ``line_id`` and every per-PO report
need.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.schema import MONEY

# Bits reserved for the line rank inside one order in ``line_id``.
LINE_RANK_BITS = 20

# Fixed values of the binding.
EXCLUDED_NATION_BUYER = 24  # customers of this nation have no buyer
SWC_PRIORITY = "1-URGENT"
NO_ORIGIN_PRIORITY = "5-LOW"
NULL_REQ_LINENUMBER = 7
QUOTE_URL_PREFIX = "http://quote/"


# Declared schemas of the test tables (only the columns the binding reads).
# Reading with a schema skips Parquet schema inference, which otherwise runs
# one small Spark job per table read.
TABLE_SCHEMAS: dict[str, str] = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def po_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Canonical PO lines (see ``schema.PO_LINE_SCHEMA``), on request dealt out
    by PO number to so many partitions, or to the session's number of shuffle
    partitions if that is larger."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_returnflag", "l_shipdate",
    )
    orders = _t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    # nation has 25 rows by definition: a fixed-size broadcast.
    nation = F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")

    # Join order for large inputs, where the dimension tables are too big
    # to broadcast: customer meets orders at order level; the lines then
    # meet part and supplier, and the order key comes last, so the result
    # is hash-partitioned by order key = PO number. line_id's window and
    # every per-PO aggregate reuse that partitioning instead of shuffling
    # the lines again (3 line-level shuffles instead of 5). nation (fixed,
    # 25 rows) is broadcast. At small scale the planner broadcasts every
    # dimension side and the lines are not shuffled by the joins at all.
    orders_c = orders.join(customer, orders.o_custkey == customer.c_custkey)
    j = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == nation.n_nationkey)
    )
    if parts:  # the join with the orders and the ranks keep these partitions
        j, orders_c = j.repartition(parts, "l_orderkey"), orders_c.repartition(parts, "o_orderkey")
    j = j.join(orders_c, F.col("l_orderkey") == F.col("o_orderkey"))
    # Row order of the extract = (order key, then the rest of the line's
    # sort key): line_id = order key * 2^20 + rank of the line in its order.
    # The rank is a window over one order's lines, which TPC-H bounds (at
    # most 13 lines per order in these tables), so no group is hot; real
    # extracts take line_id from file order instead (sources.files), with
    # no window at all.
    in_order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    j = j.withColumn(
        "line_id",
        F.col("l_orderkey") * F.lit(1 << LINE_RANK_BITS) + F.row_number().over(in_order),
    )

    base_amount = (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit(Decimal("0.1"))).cast(MONEY)
    flag = F.col("l_returnflag")
    ln = F.col("l_linenumber")
    sum_amount = (
        F.when((ln == 7) & (flag == "A"), F.lit(None).cast(MONEY))
        .when((ln == 6) & (flag == "R"), -base_amount)
        .otherwise(base_amount)
        .cast(MONEY)
    )
    pname = F.col("p_name")
    pkey = F.col("p_partkey")
    level_1 = (
        F.when(F.startswith(pname, F.lit("small")), F.lit("L1A"))
        .when(F.startswith(pname, F.lit("red")), F.concat(F.lit("L1_"), (pkey % 2).cast("string")))
        .when(F.startswith(pname, F.lit("blue")), F.concat(F.lit("L1_"), (pkey % 3).cast("string")))
        .otherwise(F.lit("L1B"))
    )
    prio = F.col("o_orderpriority")
    return j.select(
        F.col("line_id"),
        F.col("l_orderkey").alias("po_no"),
        F.col("n_name").alias("unit"),
        F.col("o_orderstatus").alias("status"),
        sum_amount.alias("sum_amount"),
        F.to_date("o_orderdate").alias("po_date"),
        # the line's last event: some days after its order
        F.date_add(F.to_date("o_orderdate"), ln).cast("timestamp").alias("last_dttm"),
        F.when(F.col("c_nationkey") == EXCLUDED_NATION_BUYER, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("B"), F.col("c_nationkey").cast("string")))
        .alias("buyer"),
        level_1.alias("level_1"),
        pname.alias("level_2"),
        F.when(prio == SWC_PRIORITY, F.lit("SWC"))
        .when(prio == NO_ORIGIN_PRIORITY, F.lit(None).cast("string"))
        .otherwise(F.lit("PUR"))
        .alias("origin"),
        F.when(ln == NULL_REQ_LINENUMBER, F.lit(None).cast("string"))
        .otherwise(F.col("l_partkey").cast("string"))
        .alias("req_id"),
        F.col("p_brand").alias("bid_category"),
        F.col("s_name").alias("vendor"),
        F.when(flag == "R", F.concat(F.lit(QUOTE_URL_PREFIX), F.col("l_partkey").cast("string")))
        .when(flag == "A", F.lit(None).cast("string"))
        .otherwise(F.lit("none"))
        .alias("quote_link"),
    )


def bid_log_2017(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _t(spark, sf_dir, "part")
        .where(F.col("p_size") <= 3)
        .select(F.col("p_partkey").cast("string").alias("req_id"))
    )


def bid_log_2018(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes 3..6 (overlapping 2017 at size 3) plus one NULL id ("Has
    Nulls")."""
    rows = (
        _t(spark, sf_dir, "part")
        .where(F.col("p_size").between(3, 6))
        .select(F.col("p_partkey").cast("string").alias("req_id"))
    )
    null_row = spark.range(1).select(F.lit(None).cast("string").alias("req_id"))
    return rows.unionByName(null_row)


# Sheet exports of the binding: the title line above each header, and the
# column that only the sheet has.
EXPORT_TITLE = 'PO lines, one "extract" a file'
COMMENT_COLUMN = "Comments"


def write_po_export(spark: SparkSession, sf_dir: str, path: str, files: int = 4) -> None:
    """The PO lines as sheet exports: CSV files, one for each
    partition of PO numbers that has lines (``files`` partitions at least), with
    a title line, then a header, then lines in ``line_id`` order. Odd files have their columns in reverse. The
    sheet has a comment column whose quoted text spans lines and holds quotes.
    The lines are shuffled by PO number once, for the join with the orders, and
    written from there."""
    from spendlens.schema import canonical_to_sheet

    lines = po_lines(spark, sf_dir, files).sortWithinPartitions("line_id")
    sheet = {**canonical_to_sheet("working"), "comment": COMMENT_COLUMN}
    comment = (
        F.when(F.col("line_id") % 5 == 0, F.concat(F.lit('said "hold",\nthen\n\n"'), F.col("status"), F.lit('"\nagain')))
        .when(F.col("line_id") % 5 == 1, F.concat(F.lit("one, "), F.col("unit")))
        .otherwise(F.lit(None).cast("string"))
    )
    names = list(sheet)
    # the low bits of this id count a partition's rows
    text = lines.withColumns({"comment": comment, "top": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, "even": F.spark_partition_id() % 2 == 0})
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cell = {n: F.coalesce(quoted(F.col(n)) if n in ("comment", "level_2", "vendor") else F.col(n).cast("string"), F.lit("")) for n in names}
    start = lambda order: F.when(F.col("top"), F.lit(f"{EXPORT_TITLE}\n{','.join(sheet[n] for n in order)}\n")).otherwise("")
    line = lambda order: F.concat(start(order), F.concat_ws(",", *[cell[n] for n in order]))
    text.select(F.when(F.col("even"), line(names)).otherwise(line(names[::-1])).alias("value")).write.option("lineSep", "\n").text(path)


def write_bid_export(bids: DataFrame, path: str, null_token: str = "N/A") -> None:
    """A bid log as a header-less sheet export: the id, then a remark."""
    bids.select(F.coalesce("req_id", F.lit(null_token)).alias("id"), F.lit("seen, checked").alias("remark")).write.csv(path)
