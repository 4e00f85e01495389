"""Hot keys: one PO holding a third of the lines, many NULL keys."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.explain import final_plan
from spendlens.operators import attach_group_total, flag_exists
from spendlens.schema import PO_LINE_SCHEMA


@pytest.fixture
def hot_lines(spark):
    n = 30000
    # a third of all lines on PO 0, a sixth with a NULL PO, the rest spread
    df = spark.range(n, numPartitions=8).select(
        F.col("id").alias("line_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0))
        .when(F.col("id") % 6 == 1, F.lit(None))
        .otherwise(F.col("id"))
        .cast("long")
        .alias("po_no"),
        F.lit("1.000").cast(PO_LINE_SCHEMA["sum_amount"].dataType).alias("sum_amount"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("req_id"),
    )
    return df


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_attach_total_hot_key_is_split_by_aqe(spark, hot_lines):
    def run():
        out = attach_group_total(hot_lines, ["po_no"], "sum_amount", "t", strategy="join")
        rows = out.groupBy("po_no").agg(F.count("*").alias("n"), F.max("t").alias("t")).collect()
        return rows, final_plan(out)

    rows, plan = _with_conf(spark, SKEW_CONF, run)
    got = {r.po_no: (r.n, r.t) for r in rows}
    assert got[0] == (10000, Decimal("10000.000"))
    assert got[None] == (5000, Decimal("5000.000"))
    assert all(n == 1 for k, (n, _) in got.items() if k not in (0, None))
    # AQE split the hot PO's partition on the line side of the join
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan


def test_flag_exists_many_null_keys(spark, hot_lines):
    lookup = spark.createDataFrame([("7",), ("11",), (None,)], "req_id string")

    def run():
        out = flag_exists(hot_lines, "req_id", lookup, "req_id", "hit")
        return {(r.req_id is None, r.hit): r.n for r in out.groupBy(F.col("req_id").isNull().alias("nul"), "hit", "req_id").agg(F.count("*").alias("n")).select("req_id", "hit", "n").collect()}

    got = _with_conf(spark, SKEW_CONF, run)
    # every NULL requisition matches the NULL in the lookup
    assert got[(True, True)] == 15000
    assert (True, False) not in got


@pytest.mark.parametrize("hot_rows", [100, 6000, 20000, 2_000_000])
def test_measured_totals_spread_hot_keys(spark, hot_lines, hot_rows):
    """The hot PO and the NULL PO get their counted total; no window group
    holds many more rows than the limit; the rows meet in one exchange."""
    out = attach_group_total(hot_lines, ["po_no"], "sum_amount", "t", hot_rows=hot_rows)
    rows = out.groupBy("po_no").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()
    got = {r.po_no: (r.n, r.a, r.b) for r in rows}
    assert got[0] == (10000, Decimal("10000.000"), Decimal("10000.000"))
    assert got[None] == (5000, Decimal("5000.000"), Decimal("5000.000"))
    assert all(v == (1, Decimal("1.000"), Decimal("1.000")) for k, v in got.items() if k not in (0, None))
    assert out.columns == [*hot_lines.columns, "t"]
    plan = final_plan(out)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_hot_keys_are_counted_exactly(spark, hot_lines):
    from spendlens.operators.totals import hot_key_totals

    found = {(r.po_no, r.s, r._hot_n) for r in hot_key_totals(hot_lines, ["po_no"], "sum_amount", "s", 4999).collect()}
    assert found == {(0, Decimal("10000.000"), 10000), (None, Decimal("5000.000"), 5000)}
    assert hot_key_totals(hot_lines, ["po_no"], "sum_amount", "s", 10000) is None
