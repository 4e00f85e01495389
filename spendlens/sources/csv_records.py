"""CSV records cut from text lines in parallel, quoted line breaks included.

A reader that splits files can't tell from a line alone whether it begins
inside a quoted field: that depends on the number of quote characters before
it in its file. Here that state is composed over splits:

1. every split counts its lines and its *odd* lines (those with an odd number
   of quotes, which open or close a quoted part); one row per split;
2. running sums over the splits give each line its number, and each split
   whether it begins inside quotes;
3. each split's lines are cut into records where they are, in Arrow batches;
4. only records that go over a split's end are grouped: their pieces, one a
   split, by the number of such records that began in the splits before.
   No other line is shuffled.

Positions come from ``monotonically_increasing_id`` over the file scan, taken
relative to the first line of the split. Both scans plan the same splits from
the same file listing; a position outside its split's lines is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.operators.joins import broadcast_if_small
from spendlens.session import ensure_checkpoint_dir, workers_find_package

LINE_COLUMNS = ("value", "_ord_file", "_ord_block")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file and split start. Lines end at ``\\n``; a
    ``\\r`` before it stays in the line until records are cut."""
    return tag_lines(spark.read.option("lineSep", "\n").text(path))


def tag_lines(text: DataFrame) -> DataFrame:
    """``value`` of a text source with ``_ord_file`` and ``_ord_block``."""
    return text.select("value", F.col("_metadata.file_path").alias("_ord_file"), F.col("_metadata.file_block_start").alias("_ord_block"))


def _quotes(c: str, quote: str) -> Column:
    return F.length(c) - F.length(F.replace(F.col(c), F.lit(quote)))


def _frozen(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def split_table(text: DataFrame, preamble_lines: int = 0, quote: str = '"', file_order: Sequence[Column] = ()) -> DataFrame:
    """One row per split of lines tagged with ``_ord_pos``: its number
    (``_sp_id``), lines, first position, odd lines (quotes in the preamble play
    no part), the lines before it overall (``_sp_off``) and in its file
    (``_sp_row``), whether it begins and ends inside quotes, and the records
    going over a split's end that began before it (``_sp_rec``). The windows
    sort one row per split."""
    odd = _quotes("value", quote) % 2
    splits = text.groupBy("_ord_file", "_ord_block").agg(
        F.count(F.lit(1)).alias("_sp_n"), F.min("_ord_pos").alias("_sp_first"), F.sum(odd).alias("_sp_odd")
    )
    order = [*file_order, "_ord_file", "_ord_block"]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_ord_file").orderBy("_ord_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), zero)
    placed = _frozen(
        splits.withColumns({"_sp_id": F.row_number().over(Window.orderBy(*order)).cast("long"), "_sp_off": earlier("_sp_n", before), "_sp_row": earlier("_sp_n", in_file)})
    )
    top = placed.where((F.col("_sp_row") < preamble_lines) & (F.col("_sp_odd") > 0))
    if not top.isEmpty():
        lines = numbered_lines(text, top, F.col("_ord_row") < preamble_lines, quote)
        title = lines.groupBy("_sp_id").agg(F.sum(F.col("_odd").cast("long")).alias("_title"))
        placed = _frozen(placed.join(title, "_sp_id", "left").withColumn("_sp_odd", F.col("_sp_odd") - F.coalesce("_title", zero)).drop("_title"))
    opened = placed.withColumn("_sp_open", earlier("_sp_odd", in_file) % 2 == 1)
    opened = opened.withColumn("_sp_ends_open", F.col("_sp_open") != (F.col("_sp_odd") % 2 == 1))
    begins = (F.col("_sp_ends_open") & (~F.col("_sp_open") | (F.col("_sp_odd") > 0))).cast("long")
    return _frozen(opened.withColumn("_sp_rec", earlier(begins, Window.orderBy("_sp_id").rowsBetween(Window.unboundedPreceding, -1))))


def numbered_lines(text: DataFrame, splits: DataFrame, keep: Column, quote: str = '"') -> DataFrame:
    """Lines that ``keep`` holds for, each split's in order, with ``_sp_id``,
    ``_ord_line`` (1, 2, ... over all files in path order), ``_ord_row`` (0,
    1, ... in the file) and ``_odd``. No sort if the measured size of
    ``splits`` allows to broadcast it, else one by split, whose groups are as
    large as a split."""
    place = F.col("_ord_pos") - F.col("_sp_first")
    at = F.when((place >= 0) & (place < F.col("_sp_n")), place).otherwise(F.raise_error(F.lit("the files changed while they were read")).cast("long"))
    offsets = splits.select("_ord_file", "_ord_block", "_sp_id", "_sp_n", "_sp_first", "_sp_off", "_sp_row", *[c for c in ("_sp_open",) if c in splits.columns])
    small = broadcast_if_small(offsets)
    joined = text.join(small, ["_ord_file", "_ord_block"])
    lines = joined.select(
        "_sp_id", *[c for c in ("_sp_open",) if c in splits.columns], (F.col("_sp_off") + at + 1).alias("_ord_line"), (F.col("_sp_row") + at).alias("_ord_row"),
        (_quotes("value", quote) % 2 == 1).alias("_odd"), "value",
    ).where(keep)
    return lines if small is not offsets else lines.repartition("_sp_id").sortWithinPartitions("_sp_id", "_ord_line")


_RECORDS = "_sp_id long, _ord_line long, _ord_row long, _begins boolean, _ends boolean, record string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split's lines (``numbered_lines``), and pieces of
    records that don't begin or don't end in it."""
    names = ["_sp_id", "_ord_line", "_ord_row", "_begins", "_ends", "record"]

    def made(split, line, row, begins, ends, record):
        n = len(record)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, split)), pa.array(line), pa.array(row), pa.array(np.full(n, begins)), pa.array(np.full(n, ends)), record.cast(pa.string())], names
        )

    split, inside, last = None, False, 0
    held: list[str] = []  # the lines so far of a record that isn't closed
    head = (0, 0, False)  # its first line and row here, and whether it begins here

    def piece(ends):
        return made(split, [head[0]], [head[1]], head[2], ends, pa.array(["\n".join(held)]))

    for batch in batches:
        sp, line, row = (batch.column(i).to_numpy() for i in (0, 2, 3))
        opens = batch.column(1).to_numpy(zero_copy_only=False)
        odd, value = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
        cuts = [0, *(np.flatnonzero(np.diff(sp)) + 1).tolist(), len(sp)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if sp[a] != split:
                if held:
                    yield piece(False)
                split, inside, held, last = sp[a], bool(opens[a]), [], line[a] - 1
                head = (line[a], row[a], False)
            if line[a] != last + 1 or (np.diff(line[a:b]) != 1).any():
                raise ValueError("the lines of a split are not in order")
            last = line[b - 1]
            after = (np.cumsum(odd[a:b]) + inside) % 2 == 1  # inside quotes at the line's end
            starts = a + np.flatnonzero(~np.concatenate(([inside], after[:-1])))
            inside = bool(after[-1])
            first = starts[0] if len(starts) else b
            held += value.slice(a, first - a).to_pylist()
            if held and (len(starts) or not inside):
                yield piece(True)
                held = []
            if len(starts):
                to = np.append(starts, b).astype(np.int32)
                if inside:
                    held = value.slice(to[-2], b - to[-2]).to_pylist()
                    head = (line[to[-2]], row[to[-2]], True)
                    to = to[:-1]
                if len(to) > 1:
                    parts = pa.ListArray.from_arrays(pa.array(to), value.cast(pa.string()))
                    yield made(split, line[to[:-1]], row[to[:-1]], True, True, pc.binary_join(parts, "\n"))
    if held:
        yield piece(False)


def spanning_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """The records that go over a split's end, of the lines of the splits that
    begin or end inside quotes. A quoted field that its file doesn't close is
    an error."""
    of = splits.select("_sp_id", "_ord_file", "_sp_rec")
    pieces = lines.mapInArrow(_records, _RECORDS).where("not (_begins and _ends)").join(broadcast_if_small(of), "_sp_id")
    grouped = pieces.groupBy("_ord_file", (F.col("_sp_rec") + F.col("_begins").cast("long")).alias("_rec")).agg(
        F.array_sort(F.collect_list(F.struct("_ord_line", "record"))).alias("_parts"),
        F.min("_ord_line").alias("_ord_line"), F.min("_ord_row").alias("_ord_row"), F.bool_or("_ends").alias("_closed"),
    )
    message = F.concat(F.lit("a quoted field is not closed: "), F.col("_ord_file"), F.lit(", line "), F.col("_ord_line"))
    record = F.array_join(F.transform("_parts", lambda p: p["record"]), "\n")
    return _frozen(grouped.select("_ord_file", "_ord_line", "_ord_row", F.when(F.col("_closed"), record).otherwise(F.raise_error(message)).alias("record")))


def csv_records(text: DataFrame, preamble_lines: int = 0, quote: str = '"', file_order: Sequence[Column] = ()) -> DataFrame:
    """(_ord_file, _ord_line, _ord_row, record) of the CSV records of tagged
    text lines, title lines left out. ``_ord_line`` numbers a record by its
    first line, over all files (ordered by ``file_order``, expressions of
    ``_ord_file``, then by path); ``_ord_row`` by its first line in the file.
    Line breaks inside a record are ``\\n`` as read; a ``\\r`` at its end goes.
    Lines that are empty outside quotes are no records."""
    workers_find_package(text.sparkSession)
    text = text.withColumn("_ord_pos", F.monotonically_increasing_id())
    splits = split_table(text, preamble_lines, quote, file_order)
    body = F.col("_ord_row") >= preamble_lines
    out = numbered_lines(text, splits, body, quote).mapInArrow(_records, _RECORDS).where("_begins and _ends")
    out = out.join(broadcast_if_small(splits.select("_sp_id", "_ord_file")), "_sp_id").select("_ord_file", "_ord_line", "_ord_row", "record")
    cut = splits.where("_sp_open or _sp_ends_open")
    if not cut.isEmpty():
        out = out.unionByName(spanning_records(numbered_lines(text, cut, body, quote), splits))
    return out.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("record") != "")


def parse_fields(df: DataFrame, record: str, width: Column, widths: Sequence[int], null_value: str = "") -> Column:
    """Array of the text fields of a CSV record with ``width`` fields (one of
    ``widths``, few); null where the record has another number of fields.
    ``""`` inside quotes is a quote."""
    options = {"nullValue": null_value, "emptyValue": null_value, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "columnNameOfCorruptRecord": "_bad"}
    out = F.lit(None).cast("array<string>")
    for m in widths:
        ddl = ", ".join(f"c{i} string" for i in range(m)) + ", _bad string"
        # one element: the record is parsed once, not once a field
        parsed = F.transform(
            F.array(F.from_csv(record, ddl, options)),
            lambda r: F.when(r["_bad"].isNull(), F.array(*[r[f"c{i}"] for i in range(m)])),  # noqa: B023
        )[0]
        out = F.when(width == m, parsed).otherwise(out)
    return out
