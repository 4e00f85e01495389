"""CSV records cut in parallel, headers per file, ordered CSV sets."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import io
import os
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spendlens.sinks.csv import plain_number, read_csv_set, write_csv, write_csv_numbered
from spendlens.sources.csv_records import csv_records, parse_fields, read_lines
from spendlens.sources.files import column_map, read_po_lines_csv


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="spendlens-csv-")


@pytest.fixture
def small_splits(spark):
    """Files are split every 48 bytes, inside fields too."""
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _file(path, rows, title=(), end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    with open(path, "w", newline="") as fh:
        fh.write("".join(t + end for t in title) + out.getvalue())


def _random_rows(rng, n, width):
    bits = ["a", "b c", '"', '""', ",", "\n", "\n\n", "", "é", "x" * 60, "\r", "\r\n"]
    field = lambda: "".join(rng.choices(bits, k=rng.randrange(0, 4))).strip("\r")
    return [[str(i)] + [field() for _ in range(width - 2)] + ["z"] for i in range(n)]


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_records_across_splits(spark, scratch, small_splits, seed, end):
    rng = random.Random(seed)
    files = {f"{scratch}/in_{k}.csv": _random_rows(rng, rng.randrange(0, 60), 4) for k in range(3)}
    for path, rows in files.items():
        _file(path, rows, ['a "title', "second, title"], end)
    found = csv_records(read_lines(spark, f"{scratch}/in_*.csv"), 2)
    assert read_lines(spark, f"{scratch}/in_*.csv").rdd.getNumPartitions() > 10
    got = found.select("_ord_line", parse_fields(found, "record", F.lit(4), [4]).alias("f")).orderBy("_ord_line").collect()
    want = [[c or None for c in r] for path in sorted(files) for r in files[path]]
    norm = lambda rows: [[None if c is None else c.replace("\r\n", "\n") for c in r] for r in rows]
    assert norm([r.f for r in got]) == norm(want)
    assert len({r._ord_line for r in got}) == len(got)


def test_record_over_many_splits_and_files_stay_apart(spark, scratch, small_splits):
    long = "line\n" * 200
    _file(f"{scratch}/a.csv", [["1", long], ["2", "x"]])
    _file(f"{scratch}/b.csv", [["3", "y"], ["4", '"\n"']])
    rows = csv_records(read_lines(spark, scratch)).orderBy("_ord_line").select("_ord_row", "record").collect()
    assert [tuple(r) for r in rows] == [(0, f'1,"{long}"'), (201, "2,x"), (0, "3,y"), (1, '4,"""\n"""')]


def test_open_quote_is_an_error(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as fh:
        fh.write('1,a\n2,"never closed\n3,c\n')
    with pytest.raises(PySparkException, match="not closed"):
        csv_records(read_lines(spark, scratch)).collect()


def test_no_files_lines_or_records(spark, scratch):
    open(f"{scratch}/empty.csv", "w").close()
    with open(f"{scratch}/title.csv", "w") as fh:
        fh.write("title\n\n\n")
    assert csv_records(read_lines(spark, scratch), 1).collect() == []


HEAD = ["PO No.", "Unit", "Status", "Sum Amount", "PO Date", "Buyer", "Vendor", "Comments"]


def _po(no, **more):
    return {"PO No.": no, "Unit": "U", "Status": "F", "Sum Amount": "1.5", "PO Date": "2018-04-01", "Buyer": "", "Vendor": "V, Inc", "Comments": 'two\n"lines"', **more}


def test_each_file_has_its_own_header(spark, scratch, small_splits):
    swapped = HEAD[::-1]
    fewer = ["Status", "PO Date", "PO No.", "Sum Amount", "Unit"]
    for name, head in (("1.csv", HEAD), ("2.csv", swapped), ("3.csv", fewer)):
        _file(f"{scratch}/{name}", [head] + [[_po(str(10 * int(name[0]) + i))[c] for c in head] for i in range(3)], ["PO extract"])
    rows = read_po_lines_csv(spark, scratch).orderBy("line_id").collect()
    assert [r.po_no for r in rows] == [10, 11, 12, 20, 21, 22, 30, 31, 32]
    assert {(r.unit, r.status, r.sum_amount, r.po_date, r.buyer) for r in rows} == {("U", "F", Decimal("1.500"), dt.date(2018, 4, 1), None)}
    assert [r.vendor for r in rows] == ["V, Inc"] * 6 + [None] * 3


def test_missing_and_repeated_columns(spark, scratch):
    assert column_map("﻿Unit,x,PO No.", "working", ["po_no"]) == (3, [2, 0] + [-1] * 12)
    with pytest.raises(ValueError, match="lacks"):
        column_map("Unit,Status", "working")
    with pytest.raises(ValueError, match="more than one"):
        column_map("Unit,Unit", "working", ["unit"])
    _file(f"{scratch}/1.csv", [HEAD, [_po("1")[c] for c in HEAD]], ["t"])
    _file(f"{scratch}/2.csv", [HEAD[1:], [_po("1")[c] for c in HEAD[1:]]], ["t"])
    with pytest.raises(ValueError, match="po_no"):
        read_po_lines_csv(spark, scratch)


def test_rows_with_another_number_of_fields(spark, scratch):
    _file(f"{scratch}/1.csv", [HEAD, [_po("1")[c] for c in HEAD], ["2", "U"]], ["t"])
    with pytest.raises(PySparkException, match="not as many fields"):
        read_po_lines_csv(spark, scratch).collect()
    rows = read_po_lines_csv(spark, scratch, bad_rows="null").orderBy("line_id").collect()
    assert [r.po_no for r in rows] == [1, None]


# ------------------------------------------------------------ sets
def _text(path):
    return "".join(open(f, newline="").read() for f in sorted(glob.glob(os.path.join(path, "part-*"))))


def test_set_is_ordered_over_many_parts(spark, scratch):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.concat(F.lit("n"), "id").alias("name")).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv(df, f"{scratch}/s", order_by=["k"])
        write_csv_numbered(df, f"{scratch}/n", order_by=["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(glob.glob(f"{scratch}/s/part-*")) > 4 and len(glob.glob(f"{scratch}/n/part-*")) > 4
    want = sorted((i * 7 % 1000, f"n{i}") for i in range(1000))
    assert _text(f"{scratch}/s") == "k,name\n" + "".join(f"{k},{n}\n" for k, n in want)
    assert _text(f"{scratch}/n") == '"","k","name"\n' + "".join(f'"{i + 1}",{k},"{n}"\n' for i, (k, n) in enumerate(want))
    back = read_csv_set(spark, f"{scratch}/n").orderBy("_line").collect()
    assert [(r.row_name, r.k, r.name) for r in back] == [(str(i + 1), str(k), n) for i, (k, n) in enumerate(want)]


CELLS = "s string, d double, n decimal(18,3), i long, b boolean, t date"


def _cells(spark):
    return spark.createDataFrame(
        [("plain", 1.5, Decimal("10.500"), 1, True, dt.date(2018, 4, 1)), ('q"u,o\nte', 100000.0, Decimal("7.000"), None, False, None),
         (None, None, None, 3, None, None), ("NA", 0.1 + 0.2, Decimal("-0.010"), 4, True, None), ("", 12345678.901234567, Decimal("100.000"), 5, None, None)],
        CELLS,
    )


def test_cells_by_type(spark, scratch):
    df = _cells(spark)
    write_csv(df, f"{scratch}/s", order_by=[F.col("i").asc_nulls_first()])
    assert _text(f"{scratch}/s") == (
        "s,d,n,i,b,t\n"
        '"q""u,o\nte",100000,7,NA,FALSE,NA\n'
        "plain,1.5,10.5,1,TRUE,2018-04-01\n"
        "NA,NA,NA,3,NA,NA\n"
        '"NA",0.3,-0.01,4,TRUE,NA\n'
        '"",12345678.9012346,100,5,NA,NA\n'
    )
    write_csv_numbered(df, f"{scratch}/n", order_by=[F.col("i").asc_nulls_first()])
    assert _text(f"{scratch}/n") == (
        '"","s","d","n","i","b","t"\n'
        '"1","q""u,o\nte",100000,7,NA,FALSE,NA\n'
        '"2","plain",1.5,10.5,1,TRUE,2018-04-01\n'
        '"3",NA,NA,NA,3,NA,NA\n'
        '"4","NA",0.3,-0.01,4,TRUE,NA\n'
        '"5","",12345678.9012346,100,5,NA,NA\n'
    )
    back = read_csv_set(spark, f"{scratch}/s").orderBy("_line").collect()
    assert [r.s for r in back] == ['q"u,o\nte', "plain", None, None, None] and back[0].i is None


def test_plain_numbers(spark):
    values = [0.0, -0.0, 1e15, 123456789012345.6, 1e17, 1e-7, 2.5e-19, 1 / 3, -1e5, 1e300, 1e-300, float("nan"), float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("t", plain_number(F.col("v"))).orderBy("i").collect()
    assert [r.t for r in rows] == [
        "0", "0", "1000000000000000", "123456789012346", "100000000000000000", "0.0000001", "0.00000000000000000025", "0.333333333333333",
        "-100000", "1.0E300", "1.0E-300", "NaN", "Inf", "-Inf", None,
    ]


def test_empty_set_and_incomplete_set(spark, scratch):
    write_csv(_cells(spark).limit(0), f"{scratch}/e")
    assert _text(f"{scratch}/e") == "s,d,n,i,b,t\n"
    assert read_csv_set(spark, f"{scratch}/e").collect() == []
    write_csv(_cells(spark), f"{scratch}/s", order_by=["i"])
    extra = f"{scratch}/s/part-00099-x.txt"
    with open(extra, "w") as fh:
        fh.write("late,row\n")
    with pytest.raises(ValueError, match="listing"):
        read_csv_set(spark, f"{scratch}/s")


def test_lines_of_records_over_lines_are_not_shuffled(spark, scratch):
    rows = [[str(i), f"two\nlines {i}"] for i in range(500)]
    _file(f"{scratch}/a.csv", rows, ['a "title'])
    spark.conf.set("spendlens.broadcast.maxBytes", "2000")
    try:
        found = csv_records(read_lines(spark, scratch), 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        records = [r.record for r in found.orderBy("_ord_line").collect()]
    finally:
        spark.conf.unset("spendlens.broadcast.maxBytes")
    assert records == [f'{a},"{b}"' for a, b in rows]
    assert "hashpartitioning" not in plan


def test_records_without_broadcast(spark, scratch, small_splits):
    rows = _random_rows(random.Random(4), 40, 4)
    _file(f"{scratch}/a.csv", rows, ["title"])
    spark.conf.set("spendlens.broadcast.maxBytes", "-1")
    try:
        found = csv_records(read_lines(spark, scratch), 1)
        got = found.select("_ord_line", parse_fields(found, "record", F.lit(4), [4]).alias("f")).orderBy("_ord_line").collect()
    finally:
        spark.conf.unset("spendlens.broadcast.maxBytes")
    assert [[(c or "").replace("\r\n", "\n") for c in r.f] for r in got] == [[c.replace("\r\n", "\n") for c in r] for r in rows]


def test_export_has_title_and_header_in_each_file(spark, scratch):
    from spendlens.sources.tpch_binding import EXPORT_TITLE, po_lines, write_po_export

    sf = "/root/testdata/sf0.001"
    write_po_export(spark, sf, f"{scratch}/x", files=3)
    heads = []
    for f in sorted(glob.glob(f"{scratch}/x/part-*")):
        with open(f, newline="") as fh:
            assert fh.readline() == EXPORT_TITLE + "\n"
            table = list(csv.reader(fh))
        heads.append(table[0])
        orders = [int(r[table[0].index("PO No.")]) for r in table[1:]]
        assert orders == sorted(orders) and {len(r) for r in table} == {len(table[0])}
    assert len(heads) >= 3 and all(h in (heads[0], heads[0][::-1]) for h in heads) and heads[0][::-1] in heads
    key = lambda d: sorted(map(str, d.select("po_no", "vendor", "level_2", "req_id", F.col("sum_amount").cast("double"), "quote_link").collect()))
    assert key(read_po_lines_csv(spark, f"{scratch}/x")) == key(po_lines(spark, sf))
