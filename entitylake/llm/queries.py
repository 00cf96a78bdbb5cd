"""Registered queries of this package, each over its whole tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.llm import (
    decontamination, hmm, lexical, line_dedup, mixing, near_dup, pieces, quality_rules, ranking, resampling, sharding, token_files, warc,
)
from entitylake.llm.common import id_text_crc, table


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "distance")


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "text", "n_lines", "n_dropped")


def op4_zstd_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.plan(words=3, percent=85))
    return named.select("doc_id", "n_shingles", "component_id", "kept")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op7_piece_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )


def op8_preference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ranking.score(docs, ranking.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_text_crc() % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_pfor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op11_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.words_taken().alias("taken"))


def op13_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    q.__name__: q
    for q in (op1_histogram_shards, op2_robust_outliers, op3_site_lines, op4_zstd_archives, op5_hamming_join, op6_hidden_markov, op7_piece_paths, op8_preference_ranking,
              op9_positional_index, op10_pfor_ids, op11_segment_resampling, op12_sainte_lague_mix, op13_term_at_a_time)
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op4_zstd_archives": warc.ORACLE, "op5_hamming_join": near_dup.ORACLE, "op3_site_lines": line_dedup.ORACLE, "op9_positional_index": decontamination.ORACLE,
           "op11_segment_resampling": resampling.ORACLE, "op12_sainte_lague_mix": mixing.ORACLE, "op13_term_at_a_time": lexical.ORACLE}
