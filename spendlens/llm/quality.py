"""Quality rules: statistics of whole texts, base limits and a learned
decision list, all as Spark SQL expressions.

The list is learned by sequential covering. From a bounded sample of labelled
documents, conditions ``feature >= t`` or ``feature <= t`` are added to a
rule while that raises its information gain on two thirds of the sample; then
the rule is pruned, from its last condition, to its best form on the other
third. A rule that is precise enough there is kept, its documents are taken
out and the next rule is grown. The list ends at the first rule that is not.
The driver sees the statistics of the sample alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import BROADCAST_ROWS, hash_sample

WINDOW_WORDS = 8
LEAST_WORDS, MOST_REPEATED = 20, (30, 100)
SYMBOLS = "#*$%&|<>"
#: The sample: labelled documents of each class, by the hash of their id.
SAMPLE_DOCUMENTS = 3_000
#: Thresholds tried a feature, conditions of a rule, rules of a list, least precision where a rule is pruned, least documents it covers.
THRESHOLDS, CONDITIONS, RULES, PRECISION, COVERED = 24, 4, 12, 0.95, 4
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share")

Rule = tuple[tuple[str, str, float], ...]


def _repeated_words(h: str) -> Column:
    """Words that lie in windows found twice or more. ``h``: column of the
    windows' hashes, in order."""
    place = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    # Sorted by hash, a repeated window stands beside its like.
    sides = F.array_sort(place)
    near = F.zip_with(sides, F.concat(F.array(F.lit(None).cast(sides_type())), sides), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(near, lambda s: s["a"]["h"] == s["b"]["h"])
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda s: F.array(s["a"]["i"], s["b"]["i"])))))
    start = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW_WORDS), x - acc["last"])).alias("n"))
    return F.aggregate(at, start, add, lambda acc: acc["n"])


def sides_type() -> str:
    return "struct<h: bigint, i: int>"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with STATISTICS and FEATURES of the whole text (null: none).
    A document without words has 0 in all of them. Windows are compared by
    64-bit hashes."""
    # Packed in a struct, the rows' own columns can't clash with those of the work.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(s))) for s in SYMBOLS[1:]), F.length(text) - F.length(F.replace(text, F.lit(SYMBOLS[0]))))
    split = docs.select(row, F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("_words"), lines.alias("_lines"), symbols.cast("long").alias("n_symbols"))
    counted = split.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_distinct": F.size(F.array_distinct("_words")),
        "_upper": F.aggregate("_words", F.lit(0), lambda n, w: n + F.when((F.substring(w, 1, 1) >= "A") & (F.substring(w, 1, 1) <= "Z"), 1).otherwise(0)),
        "_windows": F.when(
            F.size("_words") > WINDOW_WORDS,
            F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW_WORDS))),
        ).otherwise(F.array().cast("array<bigint>")),
    }).drop("_words", "_lines")
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    done = counted.withColumn("n_repeat_words", F.when(some, _repeated_words("_windows")).otherwise(F.lit(0).cast("long"))).drop("_windows")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    shares = {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("_distinct") / words,
        "upper_share": F.col("_upper") / words,
    }
    # One row each; a later filter on these columns isn't moved below it, where it would compute them again.
    found = F.array(F.struct(*STATISTICS, *[c.alias(f) for f, c in shares.items()]))
    return done.select("row", F.inline(found)).select("row.*", *STATISTICS, *FEATURES)


def base_failed() -> Column:
    part, of = MOST_REPEATED
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * of > F.col("n_words") * part)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, dict[str, float]]]:
    """(quality, features) of at most SAMPLE_DOCUMENTS labelled documents of
    each class that the base limits let through."""
    first = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    each = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = (
        hash_sample(each, "quality", "doc_id", SAMPLE_DOCUMENTS).withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_DOCUMENTS).select("doc_id", "quality")
    )
    assert 2 * SAMPLE_DOCUMENTS <= BROADCAST_ROWS
    wide = with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).where(~base_failed())
    rows = wide.select("quality", *FEATURES).orderBy(F.xxhash64(*FEATURES), "quality").limit(4 * SAMPLE_DOCUMENTS).collect()
    return [(r.quality, {f: float(r[f]) for f in FEATURES}) for r in rows]


def learned(sample: list[tuple[int, dict[str, float]]]) -> list[Rule]:
    """The ordered rules; a document that meets all conditions of one is rejected."""
    rows = list(range(len(sample)))
    bad = sum(1 << i for i in rows if sample[i][0] == 0)
    prune = sum(1 << i for i in rows if i % 3 == 2)
    all_rows = (1 << len(rows)) - 1
    conditions: dict[tuple[str, str, float], int] = {}
    for f in FEATURES:
        values = sorted({x[f] for _, x in sample if _ == 0}) or [0.0]
        cuts = sorted({values[round(k * (len(values) - 1) / (THRESHOLDS - 1))] for k in range(THRESHOLDS)})
        for t in cuts:
            conditions[f, ">=", t] = sum(1 << i for i in rows if sample[i][1][f] >= t)
            conditions[f, "<=", t] = sum(1 << i for i in rows if sample[i][1][f] <= t)

    def precise(mask: int) -> float:
        n = mask.bit_count()
        return (mask & bad).bit_count() / n if n else 0.0

    rules: list[Rule] = []
    left = all_rows
    while len(rules) < RULES and (left & bad & ~prune).bit_count() >= COVERED:
        mask, rule = left & ~prune, []
        while len(rule) < CONDITIONS and precise(mask) < 1:
            p0 = (mask & bad).bit_count()
            base = math.log2(precise(mask))
            best, gain = None, 1e-9
            for c, m in conditions.items():
                p = (mask & m & bad).bit_count()
                if p >= COVERED:
                    g = p * (math.log2(precise(mask & m)) - base)
                    if g > gain:
                        best, gain = c, g
            if best is None or p0 == 0:
                break
            rule.append(best)
            mask &= conditions[best]
        if not rule:
            break

        def worth(k: int) -> float:
            m = left & prune
            for c in rule[:k]:
                m &= conditions[c]
            p, n = (m & bad).bit_count(), (m & ~bad).bit_count()
            return (p - n) / (p + n) if p + n else -1.0

        kept = max(range(1, len(rule) + 1), key=worth)
        covered = left
        for c in rule[:kept]:
            covered &= conditions[c]
        if worth(kept) < 2 * PRECISION - 1 or precise(covered) < PRECISION:
            break
        rules.append(tuple(rule[:kept]))
        left &= ~covered
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds decides."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for f, side, t in rule:
            holds = holds & (F.col(f) >= t if side == ">=" else F.col(f) <= t)
        out = F.when(holds, True) if out is None else out.when(holds, True)
    return F.lit(False) if out is None else out.otherwise(False)


def judged(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with STATISTICS, FEATURES, base_failed and kept.

    ``rules``: learned before, or else now from ``labels`` (doc_id, quality
    0 or 1; of contradicting rows the 0 counts, others are ignored). With
    nothing to learn from there are no rules. Null text has no words and
    fails. Repeated rows and null ids are judged each; an empty table gives
    no rows. Columns of ``docs`` with the names of the results are replaced."""
    own = docs.drop(*STATISTICS, *FEATURES, "base_failed", "kept")
    rules = learned(labelled_sample(own, labels)) if rules is None else rules
    wide = with_statistics(own).withColumn("base_failed", base_failed())
    return wide.withColumn("kept", ~F.col("base_failed") & ~rejected(rules))
