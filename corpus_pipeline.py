"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each gets the documents that its
predecessor kept and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import BROADCAST_ROWS, lean_workers, saved, table, with_places
from spendlens.llm.langid import UNDETERMINED, with_language
from spendlens.llm.ngram_join import ngram_jaccard_components
from spendlens.llm.packing import packed
from spendlens.llm.quality import judged
from spendlens.llm.queries import workers_find_package
from spendlens.llm.secret_scan import without_secrets
from spendlens.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A language is accepted if the second needs more phrases by this share at least.
LEAST_SCORE = 0.01


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those that no language explains
    better than another."""
    lean_workers(spark)
    return with_language(docs).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts by the base limits and by the list learned from ``labels``."""
    return judged(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked ones: that with the smallest id
    (null last), of these the first in the order of the input's files. Rows
    are told apart by their place in the files, so ids may be null or
    repeated. Texts without words are linked with nothing and stay."""
    rows = with_places(docs, "_place")
    found = ngram_jaccard_components(rows, id_col="_place").where("n_shingles > 0")
    found = saved(found.select(F.col("doc_id").alias("_place"), "component_id"))
    many = found.groupBy("component_id").agg(F.count("*").alias("k")).where("k > 1").select("component_id")
    members = found.join(many, "component_id").join(rows.select("_place", "doc_id"), "_place")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_place")
    first = members.groupBy("component_id").agg(F.min(order).alias("o")).select("component_id", F.col("o._place").alias("_first"))
    drop = saved(members.join(first, "component_id").where("_place <> _first").select("_place"))
    some = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return rows.join(some, "_place", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kind."""
    clean = without_secrets(docs, public_tokenizers.path("word_bpe_49k.json"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL has no counterpart of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. Each stage's result is
    written as Parquet under the checkpoint folder and read again."""
    workers_find_package(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
