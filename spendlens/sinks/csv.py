"""CSV sinks: sets of ordered part files, written in parallel.

A set is a folder whose part files, in the order of their names, make up one
CSV file: the first part holds the header line, the others rows in order.
After the parts, a listing (``_listing``: place, name, bytes of each part)
is written; a set without one, or whose files differ from it, was not
completed, and ``read_csv_set`` refuses it.

``write_csv``: header and text quoted only where needed, NULL as ``NA``.
``write_csv_numbered``: as R's base writer: header and text always quoted, an
empty first header and row names 1, 2, ... below it, ``NA`` bare.

Rows are ordered by a range-partitioned sort, so every task writes the part
of its range; row numbers add the offsets of the ranges (``global_row_number``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.labels import NA_TEXT
from spendlens.operators.ordering import global_row_number
from spendlens.sources.csv_records import csv_records, parse_fields, read_lines

ROW_NAME_COL = "row_name"
LISTING = "_listing"
#: Digits of a double that are written.
SIGNIFICANT = 15


def plain_number(c: Column) -> Column:
    """A double as a plain decimal number of at most 15 significant digits,
    not in scientific notation within 1e-20 .. 1e18; NaN and infinities as
    R prints them."""
    digits = F.format_string(f"%.{SIGNIFICANT - 1}e", c)
    text = F.regexp_replace(digits.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    plain = F.when((c == 0) | text.isin("", "-0", "0", "-"), F.when(c == 0, "0").otherwise(c.cast("string"))).otherwise(text)
    special = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Inf").when(c == float("-inf"), "-Inf")
    return F.coalesce(special, plain, c.cast("string"))


def _value_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), plain_number(c.cast("double")))
    if isinstance(kind, T.DecimalType):
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if isinstance(kind, T.BooleanType):
        return F.upper(c.cast("string"))
    return c.cast("string")


def as_csv_text(df: DataFrame) -> DataFrame:
    """Every column as text, NULL as ``NA`` (the values of the CSV file, unquoted)."""
    return df.select(*[F.coalesce(_value_text(f), F.lit(NA_TEXT)).alias(f.name) for f in df.schema.fields])


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _cell(field: T.StructField, always: bool) -> Column:
    text = _value_text(field)
    if isinstance(field.dataType, T.StringType):
        special = text.rlike('[",\r\n]') | (text == NA_TEXT) | (text == "")
        text = _quoted(text) if always else F.when(special, _quoted(text)).otherwise(text)
    return F.coalesce(text, F.lit(NA_TEXT))


def _header(names: Sequence[str], always: bool) -> str:
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    return ",".join(quoted(n) if always or any(x in n for x in '",\r\n') else n for n in names)


def _write_set(header: str, lines: DataFrame, path: str, mode: str) -> None:
    """``lines`` (one text column, its partitions in order) below ``header``."""
    spark = lines.sparkSession
    head = spark.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    head.unionAll(lines).write.mode(mode).option("lineSep", "\n").text(path)
    found = _parts(spark, path)
    found.select(_place(F.col("name")).alias("place"), "name", "bytes").orderBy("place").write.mode("overwrite").json(f"{path.rstrip('/')}/{LISTING}")


def _place(name: Column) -> Column:
    """A part's number."""
    return F.regexp_extract(name, "part-([0-9]+)", 1).cast("long")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of the part files; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def _sort_cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order_by]


def write_csv(df: DataFrame, path: str, *, order_by: Sequence[str | Column] | None = None, mode: str = "overwrite") -> None:
    """``df`` as a CSV set, in ``order_by`` order or else in the order of its partitions."""
    ordered = df.orderBy(*_sort_cols(order_by)) if order_by else df
    lines = ordered.select(F.concat_ws(",", *[_cell(f, False) for f in df.schema.fields]).alias("value"))
    _write_set(_header(df.columns, False), lines, path, mode)


def with_row_names(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Prepend ``row_name`` = 1..n in ``order_by`` order (default: the
    report's first column, NULLs last); partitions are in that order."""
    order = list(order_by) if order_by else [F.col(f"`{df.columns[0]}`").asc_nulls_last()]
    numbered = global_row_number(df, order, ROW_NAME_COL)
    return numbered.select(ROW_NAME_COL, *[F.col(f"`{c}`") for c in df.columns])


def write_csv_numbered(df: DataFrame, path: str, order_by: Sequence[str | Column] | None = None, mode: str = "overwrite") -> None:
    """``df`` as a numbered CSV set: text quoted, an empty first header."""
    numbered = with_row_names(df, order_by)
    name = _quoted(F.col(ROW_NAME_COL).cast("string"))
    lines = numbered.select(F.concat_ws(",", name, *[_cell(f, True) for f in df.schema.fields]).alias("value"))
    _write_set(_header(["", *df.columns], True), lines, path, mode)


def read_csv_set(spark: SparkSession, path: str) -> DataFrame:
    """A set's rows as text columns (``NA`` is NULL), an empty header named
    ``row_name``, with ``_line``: the place of the row's first line. Raises
    if the set isn't complete."""
    base = path.rstrip("/")
    listed = spark.read.schema("place long, name string, bytes long").json(f"{base}/{LISTING}").select("name", "bytes")
    found = _parts(spark, path)
    wrong = listed.exceptAll(found).unionAll(found.exceptAll(listed)).limit(5).collect()
    if wrong:
        raise ValueError(f"{path} differs from its listing: {[r.name for r in wrong]}")
    records = csv_records(read_lines(spark, f"{base}/part-*"), file_order=[_place(F.element_at(F.split("_ord_file", "/"), -1))])
    head = records.where("_ord_line = 1").first()["record"]
    import csv

    names = [n or ROW_NAME_COL for n in next(csv.reader([head]))]
    rows = records.where("_ord_line > 1").select(F.col("_ord_line").alias("_line"), parse_fields(records, "record", F.lit(len(names)), [len(names)], NA_TEXT).alias("f"))
    return rows.select("_line", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])
