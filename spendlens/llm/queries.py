"""One query per operator of this subpackage, over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import lean_workers, table
from spendlens.llm.url_filters import Rule
from spendlens.session import workers_find_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Hosts and paths that are always blocked or let through.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def query(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.llm.ngram_join import ngram_jaccard_components

    lean_workers(spark)
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spendlens.llm.piece_bpe import encoded

    done = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spendlens.llm.packing import packed

    path = public_tokenizers.path
    return packed(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.llm.langid import identified

    return identified(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spendlens.llm.secret_scan import secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.llm.quality import judged

    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from spendlens.llm import warc
    from spendlens.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string"
    found = warc.read(spark, path, columns, verify=True)
    return found.withColumn("refers_to", F.regexp_extract("refers_to", "-?[0-9]+", 0).try_cast("long"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spendlens.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url by URL_RULES, else by its host's trust and distrust."""
    from spendlens.llm.url_filters import judged_urls

    found = judged_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the texts of ``benchmark``."""
    from spendlens.llm.resampling import resampled

    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents by language; where 3 divides the CRC-32 of
    the id (of no null id) the row checked is one whose text was lower-cased."""
    from spendlens.llm import merkle

    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = merkle.record_digest(*[F.col(c) for c in fields], F.col("text"))
    altered = merkle.record_digest(*[F.col(c) for c in fields], F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, altered).otherwise(leaf)
    found = merkle.manifest(docs, leaf, "lang", "doc_id", {"seen": seen})
    found = found.withColumn("folded_root", merkle.folded(F.col("seen"), "witness"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof("witness"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
