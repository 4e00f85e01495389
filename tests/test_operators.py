"""DataFrame operators on hand-made rows."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.operators import (
    attach_group_total,
    exclude_statuses,
    exclude_statuses_positional,
    first_per_key,
    flag_exists,
    global_row_number,
    natural_left_join,
    split_members,
    union_all,
    union_distinct,
    with_totals_row,
)


def test_first_per_key_follows_order_and_null_key(lines_factory):
    lines = lines_factory(
        [
            dict(po_no=7, unit="B", line_id=20),
            dict(po_no=7, unit="A", line_id=10),
            dict(po_no=None, unit="X", line_id=5),
            dict(po_no=None, unit="Y", line_id=3),
        ]
    )
    out = {r.po_no: r.unit for r in first_per_key(lines, ["po_no"], ["line_id"]).collect()}
    assert out == {7: "A", None: "Y"}


@pytest.mark.parametrize("n", [1, 7])
def test_global_row_number_is_dense_and_ordered(spark, n):
    df = spark.range(0, 1000, numPartitions=n).select((F.col("id") * 7919 % 1000).alias("k"))
    out = global_row_number(df, ["k"], "rn").collect()
    pairs = sorted((r.rn, r.k) for r in out)
    assert [p[0] for p in pairs] == list(range(1, 1001))
    assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)


def test_positional_status_filter_recycles(lines_factory):
    # Row i is compared with ("O", "P", "PX")[(i - 1) % 3] only.
    statuses = ["O", "O", "PX", "P", "F", "PX", None]
    lines = lines_factory([dict(status=s, line_id=i + 1) for i, s in enumerate(statuses)])
    kept = exclude_statuses_positional(lines, ["O", "P", "PX"], ["line_id"])
    assert sorted(r.line_id for r in kept.collect()) == [2, 4, 5]
    set_kept = exclude_statuses(lines, ["O", "P", "PX"])
    assert sorted(r.line_id for r in set_kept.collect()) == [5]


def test_flag_exists_null_rules(lines_factory, bids_factory):
    lines = lines_factory([dict(req_id="1", line_id=1), dict(req_id=None, line_id=2), dict(req_id="9", line_id=3)])
    with_null = flag_exists(lines, "req_id", bids_factory(["1", None, "1"]), "req_id", "hit")
    assert {r.line_id: r.hit for r in with_null.collect()} == {1: True, 2: True, 3: False}
    without_null = flag_exists(lines, "req_id", bids_factory(["1", "2"]), "req_id", "hit")
    assert {r.line_id: r.hit for r in without_null.collect()} == {1: True, 2: False, 3: False}


def test_attach_group_total_both_strategies(lines_factory):
    lines = lines_factory(
        [
            dict(po_no=1, sum_amount="1.5"),
            dict(po_no=1, sum_amount="2.5"),
            dict(po_no=None, sum_amount="4"),
            dict(po_no=None, sum_amount=None),
        ]
    )
    for strategy in ("join", "window"):
        out = attach_group_total(lines, ["po_no"], "sum_amount", "t", strategy=strategy).collect()
        assert sorted((r.po_no or 0, r.t) for r in out) == [
            (0, Decimal("4.000")), (0, Decimal("4.000")), (1, Decimal("4.000")), (1, Decimal("4.000"))
        ]


def test_natural_left_join_matches_null_keys(spark):
    a = spark.createDataFrame([("u1", 1), (None, 2), ("u3", 3)], "unit string, x int")
    b = spark.createDataFrame([("u1", 10), (None, 20)], "unit string, y int")
    out = {r.unit: (r.x, r.y) for r in natural_left_join(a, b).collect()}
    assert out == {"u1": (1, 10), None: (2, 20), "u3": (3, None)}


def test_totals_row_beside_null_label(spark):
    df = spark.createDataFrame([("a", 1, 2.0), (None, 3, 4.0)], "unit string, n long, s double")
    out = with_totals_row(df, "unit", ["n", "s"]).collect()
    got = {(r.unit, r.is_total): (r.n, r.s) for r in out}
    assert got == {("a", False): (1, 2.0), (None, False): (3, 4.0), ("Total", True): (4, 6.0)}


def test_split_members_is_a_partition(lines_factory):
    lines = lines_factory([dict(buyer=b, line_id=i) for i, b in enumerate(["B1", "B2", None, "B9"])])
    inside, outside = split_members(lines, "buyer", ["B1", "B9"])
    ins = sorted(r.line_id for r in inside.collect())
    outs = sorted(r.line_id for r in outside.collect())
    assert ins == [0, 3] and outs == [1, 2]


def test_unions(spark):
    a = spark.createDataFrame([("1",), ("2",)], "req_id string")
    b = spark.createDataFrame([("2", 5), (None, 6)], "req_id string, extra int")
    assert union_all(a, b).count() == 4
    assert "extra" in union_all(a, b).columns
    assert sorted((r.req_id or "") for r in union_distinct(a.select("req_id"), b.select("req_id")).collect()) == ["", "1", "2"]


def test_broadcast_if_small_checks_size(spark):
    from spendlens.explain import final_plan
    from spendlens.operators import broadcast_if_small

    big = spark.range(0, 20000).withColumnRenamed("id", "k")
    small = spark.range(0, 50).withColumnRenamed("id", "k").checkpoint(eager=True)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spendlens.broadcast.maxBytes", "1m")
    try:
        plan = final_plan(big.join(broadcast_if_small(small), "k"))
        assert "BroadcastHashJoin" in plan
        plan2 = final_plan(big.join(broadcast_if_small(small, max_bytes=100), "k"))
        assert "BroadcastHashJoin" not in plan2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.unset("spendlens.broadcast.maxBytes")


@pytest.mark.parametrize("bits,first", [(40, 0), (20, 1)])
def test_positions_from_groups_equal_global_row_number(spark, bits, first):
    from spendlens.operators.ordering import positions_from_groups

    # ids = group * 2^bits + dense index (from 0 like Parquet row indexes,
    # from 1 like the binding's per-order rank), groups of uneven size
    rows = []
    for g in (3, 7, 8, 20, 21):
        for i in range(g % 5 + 1):
            rows.append(((g << bits) + i + first,))
    df = spark.createDataFrame(rows, "line_id long").repartition(4)
    a = {r.line_id: r.p for r in positions_from_groups(df, "line_id", bits, "p").collect()}
    b = {r.line_id: r.p for r in global_row_number(df, ["line_id"], "p").collect()}
    assert a == b and sorted(a.values()) == list(range(1, len(rows) + 1))


def test_broadcast_size_counts_long_texts(spark):
    from spendlens.operators.joins import table_bytes

    rows = spark.createDataFrame([(1, "a" * 5000, ["xy"]), (2, None, None)], "k long, t string, l array<string>")
    assert 5000 < table_bytes(rows) < 5500
    assert table_bytes(rows.where("k > 2")) == 0
