"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the K smallest of the 48-bit hashes of a text's distinct
five-word shingles. Two fingerprints merge to that of both texts together,
and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spendlens.llm.common import U, chunks, saved, shingle_sets
from spendlens.operators.joins import broadcast_if_small

K, WIDTH, BITS = 128, 5, 48
#: Characters of a range of ids that documents are dealt to, and the quantiles
#: of the ids that ranges are cut from, at most.
RANGE_CHARACTERS, QUANTILES = 4_000_000, 1 << 10
_LEAST, _MOST = -(2**63), 2**63 - 1


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The bottom-k of each text, ascending."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        h, own = shingle_sets(texts[lo:hi], WIDTH)
        n = np.bincount(own, minlength=hi - lo)
        first = np.cumsum(n) - n
        # The sets are ascending, and the top bits keep the order.
        out += [np.unique(h[a : a + k][: K + 8] >> U(64 - BITS))[:K] for a, k in zip(first.tolist(), n.tolist())]
    return out


def written(sketch: np.ndarray) -> str:
    """Base64 of the 6-byte hashes."""
    return base64.b64encode(sketch.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.reshape(-1).view("<u8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:K]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity (exact below K shingles in all); 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merged(a, b)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < K else (K - 1) / (float(a[-1]) / 2.0**BITS)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has: among the
    hashes up to which both sketches are whole. 1 for an empty ``a``."""
    if not len(a) or not len(b):
        return float(not len(a))
    whole = min([int(x[-1]) for x in (a, b) if len(x) == K], default=1 << BITS)
    some = a[a <= whole]
    return float(np.isin(some, b).mean()) if len(some) else 0.0


def _sketched(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(s) for s in sketches(texts)], pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint), one per row of ``docs``. Null, empty and
    blank texts have the empty fingerprint."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sketched, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half] if half else text


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches):
    """Rows come by (bucket, doc_id); the row after a bucket's last is a copy
    of the next bucket's first (halo), which gives no row itself."""
    held: list[tuple] = []

    def rows(part: list[tuple]):
        """Of all but the last of ``part``."""
        texts = [r[1] for r in part]
        own = sketches([t.encode() for t in texts])
        cut = [edited(a, b) for a, b in zip(texts, texts[1:])]
        other = sketches([t.encode() for t in cut])
        out = []
        for i, text in enumerate(cut):
            if not part[i][2]:
                sha = hashlib.sha256(text.encode()).hexdigest()
                near = resemblance(own[i], other[i]), resemblance(own[i], own[i + 1])
                out.append((part[i][0], len(texts[i]), sha, written(own[i]), written(other[i]), *near))
        names = [c.split()[0] for c in EDITED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = list(zip(*out)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for row in zip(t.column("doc_id").to_pylist(), [x or "" for x in t.column("text").to_pylist()], t.column("halo").to_pylist()):
            held.append(row)
            size += len(row[1])
            if size >= 1 << 20:
                yield rows(held)
                held, size = held[-1:], 0
    if len(held) > 1:
        yield rows(held)


class Ranges(NamedTuple):
    """Ranges of ids: ``lows`` ascending, and of each the end (exclusive, or
    the greatest id), the parts it is cut into, the number of its first part,
    and whether it is one repeated id, whose rows are dealt by their text's
    hash. ``nulls`` parts for rows without id come first."""

    lows: list[int]
    ends: list[int]
    parts: list[int]
    firsts: list[int]
    single: list[bool]
    nulls: int
    count: int

    @staticmethod
    def of(rows: DataFrame, size: int = RANGE_CHARACTERS, quantiles: int = QUANTILES) -> Ranges:
        width = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 16
        no_id = F.col("doc_id").isNull()
        total = rows.agg(
            F.sum(F.when(~no_id, width)).alias("own"), F.sum(F.when(no_id, width)).alias("none"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
            F.percentile_approx("doc_id", [i / quantiles for i in range(1, quantiles)], 20 * quantiles).alias("q"),
        ).first()
        nulls = -(-(total.none or 0) // size)
        if total.lo is None:
            return Ranges([_LEAST], [_MOST], [1], [nulls], [False], nulls, nulls + 1)
        step = max(1, quantiles * size // total.own)  # quantiles that make up a range
        cuts: dict[int, int] = {}
        for v in total.q[step - 1 :: step]:
            cuts[v] = cuts.get(v, 0) + 1
        share = max(1, -(-total.own * step // (quantiles * size)))
        lows, parts, single = [_LEAST], [share], [False]
        for v, times in sorted(cuts.items()):
            if lows[-1] < v:
                lows, parts, single = [*lows, v], [*parts, share], [*single, False]
            if times > 1:  # at least times - 1 quantiles hold this id alone
                parts[-1], single[-1] = share * times, True
                if v < _MOST:
                    lows, parts, single = [*lows, v + 1], [*parts, share], [*single, False]
        ends = [*lows[1:], max(total.hi, lows[-1])]
        firsts = [nulls + sum(parts[:i]) for i in range(len(parts))]
        return Ranges([total.lo if x == _LEAST else x for x in lows], ends, parts, firsts, single, nulls, nulls + sum(parts))

    def bucket(self, ids: pa.Array, has: pa.Array, hashes: pa.Array) -> pa.Array:
        """Ascends with the id, equal ids' with the hash; null ids first."""
        own, real = ids.to_numpy(zero_copy_only=False), has.to_numpy(zero_copy_only=False)
        part_of_hash = (hashes.to_numpy(zero_copy_only=False).astype(float) + 2.0**63) / 2.0**64
        lows, ends, parts = np.array(self.lows), np.array(self.ends), np.array(self.parts)
        at = np.maximum(np.searchsorted(lows, own, side="right") - 1, 0)
        along = (own.astype(float) - lows[at]) / np.maximum(ends[at].astype(float) - lows[at], 1.0)
        where = np.where(np.array(self.single)[at], part_of_hash, along)
        part = np.clip((where * parts[at]).astype(np.int64), 0, parts[at] - 1)
        none = np.clip((part_of_hash * self.nulls).astype(np.int64), 0, max(self.nulls - 1, 0))
        return pa.array(np.where(real, np.array(self.firsts)[at] + part, none))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next), one per row of ``docs``: each text's
    fingerprint, that of its edited form (``edited`` with the next document
    by ascending id; after the last comes the first), and the resemblance of
    the text to both.

    Null text counts as empty; a text without shingles resembles only
    another such (1), else 0. Null ids come first; rows that repeat an id
    are ordered by their text's hash. The only row of a table is its own
    next. Other columns are ignored, an empty table gives no rows.

    Rows are dealt out by ranges of ids with about equally many rows
    (``Ranges``), with one row of the next range added to each; no task sorts
    the whole table, also where ids are clustered, repeated or null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = Ranges.of(rows)
    buckets = ranges.count
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(_LEAST)).alias("id"), F.col("doc_id").isNotNull().alias("has"), F.xxhash64("text").alias("h"))
    dealt = rows.withColumn("bucket", arrow_udf(ranges.bucket, "long")(F.coalesce("doc_id", F.lit(_LEAST)), F.col("doc_id").isNotNull(), F.xxhash64("text")))
    dealt = dealt.withColumn("o", order)
    firsts = saved(dealt.groupBy("bucket").agg(F.min("o").alias("o")))
    # The first row of each bucket also closes the bucket before it, the first
    # of all the last. One row a bucket.
    last = firsts.agg(F.max("bucket")).first()[0]
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.lit(last))
    heads = saved(firsts.select(F.col("o.id").alias("id"), F.col("o.has").alias("has"), F.col("o.h").alias("h"), before.alias("bucket")))
    same = (F.col("o.id") == F.col("id")) & (F.col("o.has") == F.col("has")) & (F.col("o.h") == F.col("h"))
    halo = (
        dealt.select("doc_id", "text", "o").join(broadcast_if_small(heads), same)
        .select("doc_id", "text", "bucket", "o", F.lit(True).alias("halo")).dropDuplicates(["bucket"])
    )
    both = dealt.select("doc_id", "text", "bucket", "o", F.lit(False).alias("halo")).unionByName(halo)
    key = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "halo", "o")
    return key.select("doc_id", "text", "halo").mapInArrow(_with_next, EDITED)
