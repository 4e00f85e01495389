"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.operators.joins import broadcast_if_small
from spendlens.session import ensure_checkpoint_dir

#: A broadcast of ids or keys happens only below this many rows (8-40 bytes each).
BROADCAST_ROWS = 100_000


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder:
    it cuts the lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``saved``, as a Parquet table in that folder. The planner then knows
    the table's size from its files. A checkpoint keeps the estimate of the
    plan it came from, a product over joins, and where loops join such
    tables again and again that number gets too long for the driver."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing reads any more. What was made
    from them is a table itself, so a lost executor doesn't need them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to
    any more; it does so when the driver collects garbage, which a job of few
    large steps may not reach before the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def with_places(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for each row: its file (by path) and
    its row in the file, so it is the same in every run. ``df`` is read from
    Parquet, or else written to the checkpoint folder first."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index"))
    except AnalysisException:
        df = stored(df)
        files = df.select(F.col("_metadata.file_path").alias("_file"))
    # a row per file
    ranks = saved(files.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file"))))
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    placed = df.select("*", path.alias("_file"), row.alias("_at")).join(broadcast_if_small(ranks), "_file")
    return placed.withColumn(name, F.shiftleft(F.col("_rank").cast("long"), 40) + F.col("_at")).drop("_file", "_rank", "_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_sample(rows: DataFrame, group: str, key: str, wanted: int) -> DataFrame:
    """Rows of each value of ``group`` with the smallest hashes of ``key``:
    some more than ``wanted`` rows, or all that there are. Only counts are
    shuffled, and the groups' values are few."""
    n = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    share = F.lit(0.0)
    for value, count in n.items():
        share = F.when(F.col(group) == value, min(1.0, (2 * wanted + 100) / count)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) <= share * (1 << 30))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: Bytes that Spark sends to a Python worker at once, about.
ARROW_BYTES = 4 << 20


def lean_workers(spark: SparkSession) -> None:
    """Python workers give freed memory back to the system (settings of the C
    library and Arrow): they live through all stages of one session. Rows go
    to them by some megabytes, not by ten thousand, if nothing else is set."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batch, None) is None:
        spark.conf.set(batch, str(ARROW_BYTES))
    lean = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
    for name, value in lean.items():
        spark.sparkContext.environment.setdefault(name, value)


#: What this Python worker keeps for its next tasks, by its maker and the maker's arguments.
_HELD: dict = {}


def held(make: Callable, *args):
    """``make(*args)``, made once by a Python worker as long as its tasks ask
    for nothing else. Workers live through all steps of a session: what
    another operator's tasks have kept goes first, back to the system."""
    key = (make, *args)
    if key not in _HELD:
        let_go()
        _HELD[key] = make(*args)
    return _HELD[key]


def let_go() -> None:
    """Drops what ``held`` keeps and gives freed memory back to the system."""
    _HELD.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory that the C library keeps for later goes back to the system."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memo:
    """A bounded map from a word to what ``compute`` (list of words to list
    of values) gives for it. Two halves: when the young one is full it
    becomes the old one, from which words that come again are taken back.
    Words longer than ``longest`` are computed each time."""

    def __init__(self, compute, limit: int = 600_000, longest: int = 64):
        self.young: dict = {}
        self.old: dict = {}
        self.compute, self.half, self.longest = compute, limit // 2, longest

    def values(self, texts: list[list[str]]) -> list[list]:
        """The values of the words of each text."""
        young, old = self.young, self.old
        unknown = set().union(*texts).difference(young)
        again = [w for w in unknown if w in old]  # ``intersection`` would go through all of ``old``
        young.update((w, old[w]) for w in again)
        unknown = list(unknown.difference(again))
        young.update(zip(unknown, self.compute(unknown)))
        out = [list(map(young.__getitem__, words)) for words in texts]
        for w in unknown:
            if len(w) > self.longest:
                del young[w]
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out


# ------------------------------------------------------------ word hashes
U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z counts as a-z
#: The first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _segment_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``buf``, which ends in white space.
    Words take in eight bytes a step, mixed each time, all words of a step
    at once; words over LONG_WORD bytes go through XXH3."""
    white = _WHITE[buf]
    edge = np.diff(white.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    low = np.concatenate((_LOWER[buf], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, "<u8", low.data, strides=(1,))
    out = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] * U(0xD1342543DE82EF95) + (eight[start[at] + done] & _FIRST[np.minimum(left, 8)]))
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(low[start[i] : end[i]].tobytes())
    return out, start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``texts`` in order (words are runs of bytes
    other than 0x20 and 0x09-0x0D, A-Z as a-z), and the index of its text.
    Works through segments of about 1 MB, cut at white space."""
    joined = b"\n".join(texts) + b"\n"
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    data = np.frombuffer(joined, np.uint8)
    hashes, owners, at = [], [], 0
    while at < len(data):
        to = min(at + SEGMENT, len(data))
        while to < len(data) and not _WHITE[data[to - 1]]:
            step = np.flatnonzero(_WHITE[data[to : to + SEGMENT]])
            to = to + int(step[0]) + 1 if len(step) else min(to + SEGMENT, len(data))
        h, start = _segment_hashes(data[at:to])
        hashes.append(h)
        owners.append(np.searchsorted(ends, start + at, side="right"))
        at = to
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of ``texts`` (repeats included)
    and their texts' indices, by text. A text of fewer words has one
    shingle, its whole word sequence; one without words has none."""
    words, owner = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, U)
    for k in range(width):
        out = out * U(0xD6E8FEB86659FD93) + words[k : n + k]
    whole = owner[width - 1 :] == owner[:n] if n else np.zeros(0, bool)
    out, own = mix(out[whole]), owner[:n][whole]
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.zeros(len(short), U)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] = extra[has] * U(0xA0761D6478BD642F) + words[first[has] + k]
        out = np.concatenate((out, mix(extra + count[short].astype(U))))
        own = np.concatenate((own, short))
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, each text's distinct hashes in ascending order."""
    h, own = shingles(texts, width)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new]


def chunks(texts: list[bytes], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def text_chunks(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, pa.Array]]:
    """Ranges of a string column as ``chunks`` makes them, with that part of
    the column: only one part at a time need become Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        to = min(int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0))) + 1, len(ends))
        yield at, to, column.slice(at, to - at)
        at = to
