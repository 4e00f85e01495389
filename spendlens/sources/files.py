"""File sources for PO lines and bid logs.

The ERP extract arrives as a sheet: the reference reads it from Excel
(skipping one title row) or as a plain headed sheet. Here the inputs are
CSV exports or Parquet; Excel decoding is not built. Every reader returns
the canonical schema (``schema.PO_LINE_SCHEMA``) with ``line_id`` encoding
the input row order, which order-dependent operators need:

* Parquet: ``line_id`` = rows of earlier files + row index + 1, from row
  counts per file; no shuffle of the rows.
* CSV: lines are read as text and cut into records in parallel
  (``csv_records``: numbers and quote state from per-split counts, no sort);
  each file's own header maps its columns; records are parsed with
  ``from_csv`` (JVM side).

Preferred at scale: land a CSV export once as Parquet (``land_parquet``)
and run the reports on the Parquet copy.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.joins import broadcast_if_small
from spendlens.schema import PO_LINE_SCHEMA, SHEET_LAYOUTS
from spendlens.session import ensure_checkpoint_dir
from spendlens.sources.csv_records import csv_records, parse_fields, read_lines

def canonicalize(df: DataFrame, layout: str | None = None) -> DataFrame:
    """Rename sheet headers to canonical names (absent names are skipped,
    like assigning to a missing header) and cast to the canonical types;
    canonical columns missing from the source become NULL."""
    if layout:
        df = df.withColumnsRenamed(
            {k: v for k, v in SHEET_LAYOUTS[layout].items() if k in df.columns}
        )
    cols = []
    for f in PO_LINE_SCHEMA.fields:
        if f.name == "line_id":
            continue
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.to_date(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(F.to_timestamp(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*cols, *[c for c in df.columns if c.startswith("_ord_")])


def read_po_lines_parquet(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """PO lines from Parquet files (sheet headers or canonical names).

    ``line_id`` is the row's place, 1..n, in all files by path. Rows per file
    are counted without reading a column (the files' footers have them); the
    running sum is over one row per file. So ids are dense and positions need
    no sort (``SpendParams(line_ids="dense")``)."""
    raw = spark.read.parquet(path)
    ensure_checkpoint_dir(spark)
    file = F.col("_metadata.file_path").alias("_ord_file")
    counts = raw.select(file).groupBy("_ord_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_ord_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_ord_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")).checkpoint(eager=True)
    tagged = raw.select("*", file, F.col("_metadata.row_index").alias("_ord_row"))
    line_id = F.col("_off") + F.col("_ord_row") + 1
    out = canonicalize(tagged.join(broadcast_if_small(offsets), "_ord_file").withColumn("_ord_line", line_id), layout)
    return out.select(F.col("_ord_line").alias("line_id"), *[c for c in out.columns if not c.startswith("_ord_")])


#: Different header lines that one read may meet (each is parsed on the driver).
MAX_HEADERS = 1_000
#: Canonical columns that the reports can't do without.
REQUIRED_COLUMNS = ("po_no", "unit", "status", "sum_amount", "po_date")


def read_po_lines_csv(
    spark: SparkSession,
    path: str | list[str],
    layout: str = "working",
    preamble_lines: int = 1,
    null_value: str = "",
    required: Sequence[str] = REQUIRED_COLUMNS,
    bad_rows: str = "error",
) -> DataFrame:
    """PO lines from CSV exports whose first ``preamble_lines`` lines are a
    title, followed by the header row (``read_excel(skip = 1)``).

    Files are split and their records cut in parallel (``csv_records``), so
    quoted fields may hold line breaks. Each file's own header names its
    columns: files may order them differently or have more of them. A file
    without a ``required`` column, or without a header, is an error; other
    canonical columns that it lacks are NULL. ``bad_rows``: a record whose
    number of fields differs from its header's is an error, or with "null" a
    row of NULLs.
    """
    return parse_csv_lines(read_lines(spark, path), layout, preamble_lines, null_value, required, bad_rows)


def column_map(header: str, layout: str | None, required: Sequence[str] = REQUIRED_COLUMNS) -> tuple[int, list[int]]:
    """Number of columns of a header record, and of each canonical column
    (without ``line_id``) its place there, -1 if it is absent."""
    names = next(csv.reader([header.removeprefix("\ufeff")]))
    known = SHEET_LAYOUTS[layout] if layout else {}
    canonical = [known.get(n.strip(), n.strip()) for n in names]
    wanted = [f.name for f in PO_LINE_SCHEMA.fields if f.name != "line_id"]
    missing = [c for c in required if c not in canonical]
    twice = [c for c in wanted if canonical.count(c) > 1]
    if missing or twice:
        problem = f"lacks {missing}" if missing else f"has more than one {twice}"
        raise ValueError(f"the header {header!r} {problem}")
    return len(names), [canonical.index(c) if c in canonical else -1 for c in wanted]


def parse_csv_lines(
    text: DataFrame,
    layout: str | None = "working",
    preamble_lines: int = 1,
    null_value: str = "",
    required: Sequence[str] = REQUIRED_COLUMNS,
    bad_rows: str = "error",
) -> DataFrame:
    """Canonical PO lines from text lines tagged by ``csv_records.tag_lines``;
    ``line_id`` is the number of a record's first line in read order."""
    spark = text.sparkSession
    ensure_checkpoint_dir(spark)
    records = csv_records(text, preamble_lines)
    first = F.min(F.struct("_ord_row", "_ord_line", "record")).alias("h")
    # one row per file
    heads = records.groupBy("_ord_file").agg(first).select("_ord_file", F.col("h._ord_line").alias("_head_line"), F.col("h.record").alias("_head")).checkpoint(eager=True)
    distinct = [r[0] for r in heads.select("_head").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(distinct) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers: is there a header after {preamble_lines} title line(s)?")
    maps = {h: column_map(h, layout, required) for h in distinct}
    table = spark.createDataFrame([(h, n, places) for h, (n, places) in maps.items()], "_head string, _width int, _places array<int>")
    files = broadcast_if_small(heads.join(F.broadcast(table), "_head").drop("_head").checkpoint(eager=True))
    body = records.join(files, "_ord_file").where(F.col("_ord_line") > F.col("_head_line"))
    widths = sorted({n for n, _ in maps.values()})
    parsed = body.withColumn("_fields", parse_fields(body, "record", F.col("_width"), widths, null_value))
    if bad_rows == "error":
        message = F.concat(F.lit("not as many fields as the header has: "), F.col("_ord_file"), F.lit(", line "), F.col("_ord_row") + 1)
        parsed = parsed.withColumn("_fields", F.coalesce("_fields", F.raise_error(message).cast("array<string>")))
    names = [f.name for f in PO_LINE_SCHEMA.fields if f.name != "line_id"]
    typed = canonicalize(parsed.select("_ord_line", *[F.get("_fields", F.get("_places", F.lit(i))).alias(c) for i, c in enumerate(names)]))
    return typed.select(F.col("_ord_line").alias("line_id"), *names)


def read_bid_log(spark: SparkSession, path: str, null_token: str = "N/A") -> DataFrame:
    """A bid-log sheet exported as header-less CSV; ``N/A`` is NULL; the
    first column holds the requisition id (further columns are ignored)."""
    raw = spark.read.option("header", False).option("nullValue", null_token).csv(path)
    return raw.select(F.col("_c0").cast("string").alias("req_id"))


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write canonical PO lines once as Parquet (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def land_po_lines(df: DataFrame, path: str, start_month: int = 7) -> None:
    """Land canonical PO lines partitioned by fiscal year (``fiscal_year`` =
    calendar year in which the fiscal year starts). Period filters built
    with ``operators.filters.date_range`` then also constrain
    ``fiscal_year``, so the reader skips whole folders."""
    from spendlens.functions.dates import fiscal_year_start

    with_fy = df.withColumn("fiscal_year", F.year(fiscal_year_start("po_date", start_month)))
    land_parquet(with_fy, path, partition_by=["fiscal_year"])
