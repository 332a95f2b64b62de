"""A corpus pipeline: its stages work on documents one after the other.

Language identification drops texts without a certain language, near-duplicate removal
keeps one document of each component of SimHash fingerprints that differ in 3 bits or fewer,
substring dedup takes out passages that
stand in an earlier document, mixing repeats or drops documents so that sources reach
their target weights, and byte-level BPE encodes what is left and decodes it again.
All but the last return the columns of ``documents``; after mixing a document may have
several rows.

Edge cases: texts that are null, empty or without letters go in the first stage; rows with a
null or repeated id are rows of their own in every stage, told apart by keys of the stages'
own, but repeated texts with one id lose a passage to each other only where an earlier id or
place holds it; very long texts are read whole; ties go as the operators say; a null source is a
source of its own, after all others; an empty table
gives an empty result; columns beyond those of ``documents`` are carried along up to the last
stage, whatever their names.  A stage's own tables are deleted when its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, language, mixing, simhash, substrings


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = substrings.without_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_languages),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", source_weights),
    ("byte_bpe", encoded),
]
#: A learnt classifier and a tokenizer's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, each written as Parquet and read again."""
    from weftgraph.plans.scratch import Scratch, scope

    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
