"""Shards under a byte limit by extendible hashing.

A shard is a prefix of the bits of the MD5 of a row's key. Only prefixes that
hold more than the limit are split on one more bit, so the directory is as
deep as the data need, in each place. Sizes are summed once, by fine cells of
the hash (a few for each shard to come); the directory is worked out on
those sums, and each row finds its shard by its cell. A cell that alone is
over the limit is split on further bits, by sums of its hashes, until a prefix
fits or holds a single hash. Rows with equal keys have equal hashes; only
where such a run alone is over the limit it is cut into numbered parts.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import BROADCAST_ROWS, saved

LIMIT = 8 << 20
#: Cells for each shard that the bytes need at least, and bits of the hash in use.
FINER, BITS = 64, 52
#: Bits of the prefixes whose sums come to the driver, and further bits on
#: which cells over the limit are split at a time.
TOP_BITS, STEP = 16, 8


def key_hash(key: Column) -> Column:
    """The first 52 bits of the MD5 of the key's text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def depths(cells: np.ndarray, sizes: np.ndarray, depth: int, top: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells of ``depth`` bits, in ascending order: the bits of the
    shortest prefix of ``top`` bits or more that is within the limit, else
    ``depth``, and that prefix's bytes. Sums go from fine to coarse."""
    bits, size = np.full(len(cells), depth), sizes.copy()
    for d in range(depth - 1, top - 1, -1):
        prefix = cells >> (depth - d)
        first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        total = np.repeat(np.add.reduceat(sizes, first), np.diff(np.append(first, len(cells))))
        fits = total <= limit
        bits[fits], size[fits] = d, total[fits]
    return bits, size


def _inside(depth: int, top: int, limit: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell")
        cells = t.column("cell").to_numpy()
        bits, size = depths(cells, t.column("bytes").to_numpy(), depth, top, limit)
        return pa.table({"cell": cells, "depth": bits.astype(np.int32), "shard_bytes": size})

    return run


def directory(cells: DataFrame, depth: int, limit: int, top_bits: int = TOP_BITS) -> DataFrame:
    """(cell, depth, shard_bytes): for each cell the shortest prefix within
    the limit, or the whole cell where that alone is over it.

    Cells are summed by their first ``top_bits`` bits; the driver finds the
    prefixes that are that short (2**top_bits sums at most). Where such a
    block is over the limit, a task finds the longer ones among its cells:
    2**16 of them at 500 TB and the default limit."""
    top = min(depth, top_bits)
    block = F.shiftright("cell", depth - top)
    sums = sorted(tuple(r) for r in cells.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes")).collect())
    blocks, sizes = np.array([r[0] for r in sums], np.int64), np.array([r[1] for r in sums], np.int64)
    bits, size = depths(blocks, sizes, top, 1, limit) if len(sums) else (blocks, sizes)
    found = [(int(k), int(d), int(n)) for k, d, n in zip(blocks, bits, size)]
    known = F.broadcast(cells.sparkSession.createDataFrame(found, "block long, depth int, shard_bytes long"))
    met = cells.withColumn("block", block).join(known, "block")
    if top == depth:
        return met.select("cell", "depth", "shard_bytes")
    fits = met.where(F.col("shard_bytes") <= limit).select("cell", "depth", "shard_bytes")
    over = met.where(F.col("shard_bytes") > limit).select("block", "cell", "bytes")
    return fits.unionByName(over.groupBy("block").applyInArrow(_inside(depth, top + 1, limit), "cell long, depth int, shard_bytes long"))


def sharded(rows: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``rows`` with shard (the prefix as bits, then ``.part`` if it was
    cut), shard_depth and row_bytes (UTF-8 of the text, null 0).

    Every shard holds at most ``limit`` bytes, but for a single row that is
    larger: that one has a part of its own. Null keys hash as the empty text.
    Columns of ``rows`` with the names of the results are replaced. An empty
    table gives no rows."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "shard_depth", "row_bytes")]
    # Packed in a struct, the rows' own columns can't clash with those of the work.
    own = rows.select(
        F.struct(*kept).alias("row"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("row_bytes"),
        key_hash(F.col(key)).alias("_h"),
        F.spark_partition_id().alias("_p"),
    )
    total = own.agg(F.sum("row_bytes")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(FINER * total / limit + 2))))
    cell = F.shiftright("_h", BITS - depth)
    cells = saved(own.groupBy(cell.alias("cell")).agg(F.sum("row_bytes").alias("bytes")))
    found = saved(directory(cells, depth, limit))
    if total <= limit:
        found = cells.select("cell", F.lit(0).alias("depth"), F.lit(total).alias("shard_bytes"))
    near = F.broadcast(found) if cells.count() <= BROADCAST_ROWS else found
    placed = own.withColumn("cell", cell).join(near, "cell")
    # Cells over the limit: their hashes are few, a run of equal keys is one of them.
    large = found.where(F.col("shard_bytes") > limit).select("cell")
    parts = placed.withColumn("part", F.lit(None).cast("long"))
    n_large = large.count()
    if n_large:
        inside = own.withColumn("cell", cell).join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "cell")
        finer = saved(_deeper(saved(inside.groupBy("_h").agg(F.sum("row_bytes").alias("bytes"))), depth, limit))
        finer = F.broadcast(finer) if finer.count() <= BROADCAST_ROWS else finer
        both = placed.join(finer, "_h", "left")
        placed = both.withColumns({c: F.coalesce(f"_{c}", c) for c in ("depth", "shard_bytes")}).drop("_depth", "_shard_bytes")
        parts = _parted(placed, F.col("shard_bytes") > limit, limit)
    bits = F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), BITS, "0")
    prefix = F.when(F.col("depth") > 0, F.substring(bits, F.lit(1), F.col("depth"))).otherwise("")
    shard = F.concat(prefix, F.coalesce(F.concat(F.lit("."), F.col("part").cast("string")), F.lit("")))
    return parts.select("row.*", shard.alias("shard"), F.col("depth").cast("int").alias("shard_depth"), "row_bytes")


def _deeper(hashes: DataFrame, depth: int, limit: int) -> DataFrame:
    """(_h, _depth, _shard_bytes): for each hash of cells over the limit the
    shortest prefix of more than ``depth`` bits that is within the limit or
    holds no other hash. At all bits each hash is alone."""
    done, left = [], hashes
    while True:
        to = min(BITS, depth + STEP)
        # Dealt by the prefix so far: the windows below need no further shuffle.
        sums = left.withColumn("cell", F.shiftright("_h", BITS - depth)).repartition("cell")
        for d in range(depth + 1, to + 1):
            same = Window.partitionBy("cell", F.shiftright("_h", BITS - d))
            sums = sums.withColumns({f"s{d}": F.sum("bytes").over(same), f"o{d}": F.min("_h").over(same) == F.max("_h").over(same)})
        ends, size = F.lit(None).cast("int"), F.lit(None).cast("long")
        for d in range(to, depth, -1):
            fits = (F.col(f"s{d}") <= limit) | F.col(f"o{d}")
            ends, size = F.when(fits, d).otherwise(ends), F.when(fits, F.col(f"s{d}")).otherwise(size)
        split = saved(sums.select("_h", "bytes", ends.alias("_depth"), size.alias("_shard_bytes")))
        done.append(split.where("_depth is not null").drop("bytes"))
        left, depth = split.where("_depth is null").select("_h", "bytes"), to
        if depth == BITS or left.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def _parted(placed: DataFrame, over: Column, limit: int) -> DataFrame:
    """Numbers the parts of runs of equal hashes over the limit. Rows are
    told apart by how often their size fits the limit (once, 2, 4, 8, 16
    times or more) and fill parts by their running bytes, or by their number
    where that gives no more parts. Sums run within each partition of the
    source, so no task gets a whole hot key."""
    size, group = F.col("row_bytes"), ["_h", "_c", "_p"]
    often = F.lit(4)
    for c in (3, 2, 1, 0):
        often = F.when(size * (2 << c) > limit, c).otherwise(often)
    big = placed.where(over).withColumn("_c", often)
    # Rows of equal size can change places: the sums are the same in each run of a task.
    to_here = Window.partitionBy(*group).orderBy("row_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = big.withColumns({"_k": F.count("*").over(to_here) - 1, "_b": F.sum("row_bytes").over(to_here) - size})
    counts = saved(big.groupBy(*group).agg(F.count("*").alias("k"), F.sum("row_bytes").alias("b"), F.max("row_bytes").alias("m")))
    before = Window.partitionBy("_h", "_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*group, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}0") for c in "kb"))
    # A part takes ``room`` rows, or the rows that start in ``span`` bytes: both end within the limit.
    kinds = counts.groupBy("_h", "_c").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.max("m").alias("m"))
    kinds = kinds.withColumns({
        "_room": F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("m", F.lit(1)))).cast("long"),
        "_span": F.greatest(F.lit(1), limit - F.col("m") + 1).cast("long"),
    })
    rows, span = F.ceil(F.col("k") / F.col("_room")), F.greatest(F.lit(1), F.ceil(F.col("b") / F.col("_span")))
    kinds = kinds.select("_h", "_c", "_room", "_span", F.least(rows, span).alias("_n"), (rows <= span).alias("_rows"))
    first = Window.partitionBy("_h").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("_f", F.coalesce(F.sum("_n").over(first), F.lit(0)))
    numbered = ranked.join(offset, group).join(kinds, ["_h", "_c"])
    nth = F.when(F.col("_rows"), F.floor((F.col("_k0") + F.col("_k")) / F.col("_room"))).otherwise(F.floor((F.col("_b0") + F.col("_b")) / F.col("_span")))
    # Empty texts at the end start where the last part ends.
    done = numbered.withColumn("part", (F.col("_f") + F.least(nth, F.col("_n") - 1)).cast("long")).select(*placed.columns, "part")
    return done.unionByName(placed.where(~over).withColumn("part", F.lit(None).cast("long")))
