"""A corpus from documents to packed windows: each stage on what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from xspace.llm.common import settle, small_side, table, without
from xspace.llm.exact_dedup import exact_dedup
from xspace.llm.jaccard_join import jaccard_groups
from xspace.llm.packing import pack
from xspace.llm.pii import pseudonymise
from xspace.llm.quality import quality_rules

# A key for tests and benchmarks; production jobs pass their own secret.
PII_KEY = "example key"
ORACLE_SQL = None  # covariance estimates, permutations and least squares are beyond SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows without an id cannot be named and stay."""
    verdicts = quality_rules(docs)
    return without(docs, verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("id")).where("id IS NOT NULL"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of repeated rows one."""
    found = settle(exact_dedup(docs, keep="largest").where(~F.col("kept") & F.col("doc_id").isNotNull()))
    rest = without(docs, found.where("doc_id <> keep_id").select(F.col("doc_id").alias("id")))
    twice = found.where("doc_id = keep_id").select(F.col("doc_id").alias("id")).distinct()
    again = small_side(settle(twice.withColumnRenamed("id", "_twice")), 64)
    one = rest.join(again, rest["doc_id"] == again["_twice"], "left_semi").dropDuplicates(["doc_id", "text"])
    return without(rest, twice).unionByName(one)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates."""
    groups = jaccard_groups(docs)
    return without(docs, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by pseudonyms; n_chars follows the text."""
    out = pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
