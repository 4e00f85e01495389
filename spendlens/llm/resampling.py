"""Target-distribution importance resampling over hashed n-grams.

Features are runs of 1 to ``max_n`` words; each falls into a bucket. A
bucket's gain is the logarithm of its share in the target over its share in
the corpus; a document's weight is the sum over its features; the highest
weights plus Gumbel noise are drawn, which samples without replacement in
proportion to the likelihood ratio.

Line breaks separate words, so a text is its lines and their features. Each
distinct line of the corpus is cut into features once (a table keeps their
buckets); its counts are multiplied by its occurrences for the corpus's
counts, and its weight is computed once and added for each occurrence.
N-grams across line breaks are counted apart, from the first and last words
of the lines of each document.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stored
from spendlens.operators.ordering import global_row_number

#: Runs of other bytes are words; A-Z counts as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that make up this share of all line rows are joined by broadcast: there are at most 1000.
HOT_SHARE = 1000


class Sampling(NamedTuple):
    max_n: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def _bucket(gram: Column, s: Sampling) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(s.buckets)).cast("int")


def line_buckets(words: str, s: Sampling) -> Column:
    """Buckets of the runs of 1 to ``max_n`` of ``words``, repeats included."""
    out = F.transform(words, lambda w: _bucket(w, s))
    for n in range(2, s.max_n + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        out = F.concat(out, F.transform(starts, lambda i: _bucket(F.array_join(F.slice(words, i, n), " "), s)))  # noqa: B023
    return out


def seam_buckets(text: Column, s: Sampling) -> Column:
    """Buckets of the runs of 2 to ``max_n`` words that cross a line break.
    Of each line only the first and last ``max_n - 1`` words are kept, with a
    null between them where words are left out."""
    k = s.max_n - 1

    def ends(line: Column, number: Column) -> Column:
        words = words_of(line)
        gap = F.array(F.lit(None).cast("string"))
        cut = F.when(F.size(words) <= 2 * k, words).otherwise(F.concat(F.slice(words, 1, k), gap, F.slice(words, -k, k)))
        return F.transform(cut, lambda w: F.struct(w.alias("w"), number.alias("line")))

    def crossing(kept: Column) -> Column:
        out = F.array().cast("array<int>")
        for n in range(2, s.max_n + 1):
            starts = F.when(F.size(kept) >= n, F.sequence(F.lit(1), F.size(kept) - (n - 1))).otherwise(F.array().cast("array<int>"))
            runs = F.transform(starts, lambda i: F.slice(kept, i, n))  # noqa: B023
            across = F.filter(runs, lambda r: (r[0]["line"] != r[n - 1]["line"]) & ~F.exists(r, lambda x: x["w"].isNull()))  # noqa: B023
            out = F.concat(out, F.transform(across, lambda r: _bucket(F.array_join(F.transform(r, lambda x: x["w"]), " "), s)))
        return out

    kept = F.flatten(F.transform(F.split(text, "\n"), ends))
    # the reduced texts are named once, and not computed again for each n
    return F.transform(F.array(kept), crossing)[0]


def _key(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def distinct_lines(texts: DataFrame, s: Sampling) -> DataFrame:
    """(key, occurrences, buckets, n_words) of each distinct line of the column ``text``."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("occurrences"))
    cut = lines.select(_key(F.col("line")).alias("key"), "occurrences", words_of(F.col("line")).alias("words"))
    return cut.select("key", "occurrences", line_buckets("words", s).alias("buckets"), F.size("words").alias("n_words"))


def bucket_counts(texts: DataFrame, lines: DataFrame, s: Sampling) -> list[int]:
    """Features of each bucket over all ``texts`` (``lines``: their distinct
    lines). At most ``buckets`` rows come to the driver."""
    each = lines.select(F.explode("buckets").alias("b"), F.col("occurrences").alias("k"))
    if s.max_n > 1:
        each = each.unionByName(texts.select(F.explode(seam_buckets(F.col("text"), s)).alias("b"), F.lit(1).cast("long").alias("k")))
    counts = [0] * s.buckets
    for r in each.groupBy("b").agg(F.sum("k").alias("k")).collect():
        counts[r.b] = r.k
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket floor(1000 * ln(its smoothed share in the target / in the corpus))."""
    b, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + float(b)) / ((s + 1.0) * (all_t + float(b))))) for s, t in zip(corpus, target)]


def _noise(doc_id: Column, s: Sampling) -> Column:
    text = F.concat(F.lit(f"{s.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, s: Sampling = Sampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of
    ``docs`` (doc_id, text); ``target`` needs a column text. ``rank`` is 1, 2,
    ... over the drawn ones, null for others.

    Null or empty text has no words, weight 0. Repeated rows are documents
    each, and count each; so are rows that share an id. A null id is seeded
    as the empty text and comes last among ties. Without documents there are
    no rows; without a target every bucket's count is 0 there. Other columns
    play no part. Lines are compared by 128 bits of SHA-256."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    texts, wanted = docs.select(text), target.select(text)
    lines = stored(distinct_lines(texts, s))
    gain = gains(bucket_counts(texts, lines, s), bucket_counts(wanted, distinct_lines(wanted, s), s))
    of = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    weight = lambda buckets: F.aggregate(buckets, F.lit(0).cast("long"), lambda w, b: w + F.get(of, b))

    # One row a line of a document. The first one also stands for the document.
    rows = docs.select("doc_id", text).withColumn("text_key", _key(F.col("text")))
    each = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "text_key", (F.col("at") == 0).cast("long").alias("docs"), _key(F.col("line")).alias("key"))
    per_line = lines.select("key", "occurrences", "n_words", F.size("buckets").alias("n_features"), weight("buckets").alias("weight"))
    total = lines.agg(F.sum("occurrences")).first()[0] or 0
    values = ["n_words", "n_features", "weight"]
    hot = stored(per_line.where(F.col("occurrences") * HOT_SHARE >= total).select("key", F.struct(*values).alias("hot")))
    cold = per_line.where(F.col("occurrences") * HOT_SHARE < total).select("key", F.struct(*values).alias("cold"))
    # Rows of hot lines are done; a key of their own spreads them over the second join.
    own = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id", "text_key"))))
    met = each.join(F.broadcast(hot), "key", "left").withColumn("key", own).join(cold, "key", "left")
    line = F.coalesce("hot", "cold")
    sums = met.groupBy("doc_id", "text_key").agg(F.sum("docs").alias("docs"), *[F.sum(line[v]).alias(v) for v in values])
    # Equal rows were added up: each gets its part, as many times.
    done = sums.select("doc_id", "text_key", "docs", *[F.expr(f"{v} div docs").cast("long").alias(v) for v in values])
    if s.max_n > 1:
        seams = rows.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", seam_buckets(F.col("text"), s).alias("b"))
        seams = seams.select(F.col("doc_id").alias("id"), F.col("text_key").alias("tk"), F.size("b").cast("long").alias("more"), weight("b").alias("plus"))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tk"))
        done = done.join(seams, same).select("doc_id", "docs", "n_words", (F.col("n_features") + F.col("more")).alias("n_features"), (F.col("weight") + F.col("plus")).alias("weight"))
    scored = done.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), s))
    scored = stored(scored.select("doc_id", "n_words", "n_features", "weight", "score", F.explode(F.array_repeat(F.lit(0), F.col("docs").cast("int"))).alias("copy")).drop("copy"))
    able = scored.where(F.col("n_words") >= s.least_words)
    draw = s.percent * able.count() // 100
    ranked = global_row_number(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    others = scored.where(F.col("n_words") < s.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others.select(*ranked.columns))
