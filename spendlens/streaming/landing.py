"""Incremental landing of PO-line extracts with Structured Streaming.

New extract files dropped into a folder are picked up by a file stream,
canonicalized, given ``line_id`` values that keep file order across
batches, and appended to a Parquet table that the batch reports read.
Run it with ``trigger(availableNow=True)`` from a scheduler (process what
is there, then stop) or as a long-running stream.

Fault tolerance: the stream's checkpoint (offsets of files already taken)
lives in a shared folder; each micro-batch is written to its own
``batch=<id>`` folder with overwrite, so a batch that is replayed after a
failure replaces its own output instead of adding it twice.

``line_id`` = batch id * 2^44 + number of the row inside the batch (rows of
the files before it, by path, + row index in the file): later drops sort after
earlier ones. A batch may have any number of files and 2^44 rows; a longer
batch, or a batch id from 2^19 on, is an error instead of a repeated id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens.sources.csv_records import tag_lines
from spendlens.sources.files import canonicalize, parse_csv_lines

BATCH_BITS = 44


def _line_id(batch_id: int, place: Column) -> Column:
    """Id of the row at ``place`` inside the batch."""
    if batch_id >= 1 << (63 - BATCH_BITS):
        raise ValueError(f"batch {batch_id}: line_id has no room for more than {1 << (63 - BATCH_BITS)} batches")
    too_long = F.raise_error(F.lit(f"batch {batch_id}: line_id has no room for more than 2^{BATCH_BITS} rows in a batch"))
    return F.when(place < F.lit(1 << BATCH_BITS), F.lit(batch_id << BATCH_BITS) + place).otherwise(too_long.cast("long"))


def _land_batch(target: str, layout: str | None):
    def run(batch: DataFrame, batch_id: int) -> None:
        files = batch.groupBy("_ord_file").agg((F.max("_ord_row") + 1).alias("_n"))
        before = Window.orderBy("_ord_file").rowsBetween(Window.unboundedPreceding, -1)
        firsts = files.select("_ord_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
        tagged = batch.join(F.broadcast(firsts), "_ord_file")
        line_id = _line_id(batch_id, F.col("_first") + F.col("_ord_row"))
        out = canonicalize(tagged.withColumn("_ord_line", line_id), layout)
        out = out.select(
            F.col("_ord_line").alias("line_id"), *[c for c in out.columns if not c.startswith("_ord_")]
        )
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return run


def land_po_lines(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_dir: str,
    source_schema,
    layout: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the landing stream (Parquet drops with ``source_schema``, sheet
    headers mapped by ``layout``). Returns the running query."""
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir).select(
        "*",
        F.col("_metadata.file_path").alias("_ord_file"),
        F.col("_metadata.row_index").alias("_ord_row"),
    )
    writer = stream.writeStream.foreachBatch(_land_batch(target_dir, layout)).option(
        "checkpointLocation", checkpoint_dir
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _land_csv_batch(target: str, layout: str, preamble_lines: int):
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():  # empty micro-batch
            return
        lines = parse_csv_lines(batch, layout, preamble_lines)
        out = lines.withColumn("line_id", _line_id(batch_id, F.col("line_id")))
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return run


def land_po_lines_csv(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_dir: str,
    layout: str = "working",
    preamble_lines: int = 1,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Landing stream for CSV export drops (title line(s), then a header):
    each micro-batch's files are read as text, cut into records in parallel
    (quoted line breaks included), mapped by each file's own header and
    parsed JVM-side; ``line_id`` = batch id * 2^44 + number of the record's
    first line inside the batch."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = tag_lines(reader.option("lineSep", "\n").text(source_dir))
    writer = stream.writeStream.foreachBatch(_land_csv_batch(target_dir, layout, preamble_lines)).option(
        "checkpointLocation", checkpoint_dir
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
