"""Quality rules, exact dedup, near-dedup, mixing and encoding of a table of documents."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinflow.llm import bpe, divergence_rules, mixing, near_dedup, trie_dedup
from skeinflow.llm.session import cut


def _without(docs: DataFrame, gone: DataFrame, key) -> DataFrame:
    """docs without the rows whose (doc_id, key) is in gone (gone_id, gone_key); columns of docs may have any name."""
    same = F.col("d.doc_id").eqNullSafe(F.col("g.gone_id")) & (key == F.col("g.gone_key"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti")


def _once(docs: DataFrame, twice: DataFrame, key) -> DataFrame:
    """docs with a single row of each (doc_id, key) in twice (twice_id, twice_key); columns of docs may have any name."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), key.alias("row_key"))
    same = F.col("row_id").eqNullSafe(F.col("twice_id")) & (F.col("row_key") == F.col("twice_key"))
    single = keyed.join(twice, same, "left_semi").dropDuplicates(["row_id", "row_key"])
    return keyed.join(twice, same, "left_anti").unionByName(single).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and very short texts go (the rules want 20 words); rows with equal or
    null ids are judged by their own text; a text of any length is measured whole;
    an empty table stays empty; columns of any name are carried along.
    """
    verdicts = divergence_rules.quality_verdicts(docs)
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return _without(docs, gone, F.xxhash64(F.col("d.text")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that of the largest id; of rows with equal or null ids only those of that text go.

    A null text equals an empty one; of a group without ids, or with several rows of
    the largest id, any one stays; an empty table stays empty; columns of any name
    are carried along.
    """
    groups = trie_dedup.exact_duplicates(docs)
    text = lambda name: F.sha2(F.translate(F.coalesce(name, F.lit("")), ascii_uppercase, ascii_lowercase), 256)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_key")).distinct()
    kept = groups.where(F.col("kept") & (F.col("group_size") > 1))
    twice = kept.groupBy(F.col("doc_id").alias("twice_id"), F.col("text_sha256").alias("twice_key")).count().where("count > 1").drop("count")
    return _once(_without(docs, gone, text("d.text")), twice, text("text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate component stays, as its component is named; if several of its rows have that id, or all have none, one of them.

    Texts without words are in no component and stay; an empty table stays empty;
    columns of any name are carried along.
    """
    classes = cut(near_dedup.near_duplicate_classes(docs))
    kept = classes.where(F.col("kept") & F.col("root").isNotNull())
    several = kept.groupBy("root").agg(F.min("text_key").alias("first_key"), F.count("*").alias("n")).where("n > 1")
    others = kept.join(several, "root")
    gone = classes.where(~F.col("kept")).unionByName(others.where("text_key <> first_key").select(classes.columns))
    left = _without(docs, gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), F.xxhash64(F.col("d.text")))
    return _once(left, others.where("text_key = first_key").select(F.col("doc_id").alias("twice_id"), F.col("text_key").alias("twice_key")).distinct(), F.xxhash64(F.col("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once for each copy.

    Null is a source of its own; texts without words cost nothing and come with their
    block; rows with equal ids are rows of their own; an empty table stays empty;
    columns of any name are carried along.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of the bytes decoded from the ids) of every row.

    A null or empty text has no tokens; copies are encoded like other rows; an empty
    table stays empty; other columns are left behind.
    """
    return bpe.encode_documents(docs, *bpe.vocabulary())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup_stage), ("mixing", mix_sources), ("byte-level BPE", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
