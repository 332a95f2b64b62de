"""The corpus queries by name, each over its whole tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, language, lines, mixing, neighbours, phrases, quality, ranking, revisits, simhash, substrings, token_counts, toxicity
from weftgraph.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("host", "h", "removed_lines")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out())
    return language.identify(docs, model).withColumn("held_out", language.held_out())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return resolved.select("record_id", "url", "target_id", "state", header("etag").alias("etag"), header("date").alias("date"), header("content-length").alias("content_length"), header("content-type").alias("content_type"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, network).withColumn("held_out", toxicity.held_out())
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sale_ranks(table(spark, sf_dir, "sale_lines"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_neighbours": op8_neighbours,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_ranking_ties": op13_ranking_ties,
}
ORACLE: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_quality_rules": quality.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op5_simhash": simhash.ORACLE,
    "op7_warc_revisits": revisits.ORACLE,
    "op11_line_dedup": lines.ORACLE,
    "op12_collocations": phrases.ORACLE,
    "op13_ranking_ties": ranking.ORACLE,
}
