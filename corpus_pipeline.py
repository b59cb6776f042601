"""The corpus pipeline: quality, near duplicates, personal data, source mix, packing.

Python workers live on from stage to stage beside the executor's heap, so every stage limits the session's
Arrow batches (``common.limit_batches``), also for the caller's own write of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import minhash, mixing, packing, pii, quality
from tallywright.llm.common import limit_batches, only, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses the trained classifier of the first stage; the tests hold each stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others, so they may go; a null doc_id stays, and rows that repeat a
    doc_id go only together. An empty table stays empty; other columns than those of documents are dropped.
    """
    limit_batches(spark)
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates stays, that with the least doc_id.

    Rows that repeat a doc_id are compared like rows of different documents, so unlike texts of one doc_id
    all stay, and of its copies and near copies one; a null text stays only if its doc_id has no other.
    A null doc_id stays.
    """
    limit_batches(spark)
    docs = docs.select(*COLUMNS)
    repeated = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone"))
        return only(docs, "doc_id", gone, "left_anti")
    repeated = docs.join(repeated, F.col("doc_id") == F.col("id"), "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("least"))
    no_id = docs.filter("doc_id is null")
    once = docs.join(repeated, F.col("doc_id") == F.col("id"), "left_anti").filter("doc_id is not null").withColumn("key", F.col("doc_id"))
    texts = docs.join(repeated, F.col("doc_id") == F.col("id")).filter("text is not null or least is null")
    texts = texts.groupBy("doc_id", "text", "least").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    # the least text of a doc_id keeps the id as its key, the others get keys above all ids
    new = docs.agg((F.max("doc_id") + 1).alias("from"))
    texts = texts.crossJoin(F.broadcast(new)).withColumn("key", F.when(F.col("text").eqNullSafe(F.col("least")), F.col("doc_id")).otherwise(F.col("from") + F.monotonically_increasing_id()))
    keyed = stored(once.unionByName(texts.select("doc_id", "text", "row.*", "key")), "keyed")
    found = minhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("of"), "component_id")
    found = keyed.select("doc_id", "key").join(found, F.col("key") == F.col("of"))
    stay = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("stays"))
    return keyed.join(stay, F.col("key") == F.col("stays"), "left_semi").select(*COLUMNS).unionByName(no_id)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and revealing words are replaced in the texts; n_chars follows.

    Every row stays, null and repeated doc_ids too; a null text becomes empty, equal texts stay equal.
    """
    limit_batches(spark)
    docs = docs.select(*COLUMNS)
    return pii.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target weights.

    A null source is one more source. Documents without words, null texts too, weigh nothing and go with
    their neighbours in the order of the mix. Rows of one doc_id are told apart by their size.
    """
    limit_batches(spark)
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents are packed into sequences of 2048 tokens, one row per piece.

    A null or empty text is the end id alone; repeated rows and null doc_ids are packed like others.
    """
    limit_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("personal_data", pii_stage),
    ("source_mix", mix_stage),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
