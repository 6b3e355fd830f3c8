"""From raw documents to packed batches: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.llm.jaccard import similar_documents
from vistaframe.llm.mixing import mix
from vistaframe.llm.packing import pack
from vistaframe.llm.perplexity import perplexity_rules
from vistaframe.llm.repeats import drop_repeats
from vistaframe.llm.shared import cut, free_name, fresh_path, keyed, maybe_broadcast

#: SQL can't express the perplexity model; tests compare the stages with brute force.
ORACLE_SQL = None


def _without(base: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of base whose key isn't among the doc_ids of ``gone``, without the key."""
    name = free_name(base, "_gone")
    gone = cut(gone.select(F.col("doc_id").alias(name)))
    return base.join(maybe_broadcast(gone, gone.count()), F.col(key) == F.col(name), "left_anti").drop(key)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that lie outside the perplexity bands of their language.

    Rows are judged by themselves, also those with a null or repeated doc_id; null and empty texts, and texts without
    a word, are rejected; a null language is one of the empty name; equal rows fare alike; other columns are kept.
    """
    base, key = keyed(docs)
    return _without(base, key, perplexity_rules(base.select(F.col(key).alias("doc_id"), "text", "lang")).where("not keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of similar texts connect.

    First is the smallest doc_id, and where some are null or repeated the first in the order of doc_id (nulls first)
    and a hash of the text, so that of rows that are equal throughout one stays. Null and empty texts, and texts
    without a word, are similar to none and stay; other columns are kept.
    """
    base, key = keyed(docs)
    return _without(base, key, similar_documents(base.select(F.col(key).alias("doc_id"), "text")).where("class_id != doc_id"))


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that occur earlier; see ``drop_repeats`` for order, nulls, repeated rows and other columns."""
    return drop_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with the shard to which its source's block is dealt.

    Rows are dealt by themselves, also those with a null or repeated doc_id; null sources are one of the empty name,
    null texts one token; a column ``shard`` gives way to the new one, other columns are kept.
    """
    base, key = keyed(docs.drop("shard"))
    name = free_name(base, "_dealt")
    dealt = cut(mix(base.select(F.col(key).alias("doc_id"), "text", "source"), go_on=True).select(F.col("doc_id").alias(name), "shard"))
    # a row for each document is never small for long, so the join is the same at every size
    return base.join(dealt, F.col(key) == F.col(name)).drop(key, name)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for each document, the batches of a bucket filled shard by shard as ``mixture`` dealt them.

    See ``pack`` for nulls, ties, repeated rows and empty tables; without a column ``shard`` the ids alone give the order. Other columns are not read.
    """
    return pack(docs, shard="shard" if "shard" in docs.columns else None)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("mixture", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
