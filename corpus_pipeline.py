"""The training-data pipeline: quality, boilerplate lines, near copies, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. A row is
named by doc_id and its text, so null and repeated ids are judged row by row; rows that are equal in both
share every decision, and the near-copy stage keeps one of them. Null and
empty texts are judged like others and never are copies or contaminated. Extra columns of documents are kept,
but those named as results of a stage are replaced. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.llm import decontamination, line_dedup, near_dup, pieces, ranking
from entitylake.llm.common import shared_folder, small, stored_rows, table

#: Near copies: five-word shingles, eight tenths in common.
COPIES = near_dup.plan(words=5, percent=80)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows named in ``rejected`` (doc_id, text_hash).

    The names are stored, and sent to all executors while they are few; else Spark shuffles both sides.
    """
    names, fits = stored_rows(rejected.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), 24)
    same = (F.xxhash64(docs["text"]) == names["_hash"]) & docs["doc_id"].cast("long").eqNullSafe(names["_id"])
    return docs.join(small(names, fits), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking predicts to be good, learnt from the labels outside the held-out fifth."""
    model = ranking.fit(docs, table(spark, sf_dir, "labels"))
    return ranking.score(docs, model).filter(F.col("predicted") == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, then of the smallest hash of its text."""
    verdict = near_dup.chosen_rows(docs, COPIES)
    rest = _without(docs, verdict.filter(~F.col("chosen")))
    again = verdict.filter(F.col("chosen") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_hash").count()
    again = again.filter(F.col("count") > 1).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    names, fits = stored_rows(again, 24)
    if names.isEmpty():
        return rest
    same = (F.xxhash64(rest["text"]) == names["_hash"]) & rest["doc_id"].cast("long").eqNullSafe(names["_id"])
    repeated = rest.join(small(names, fits), same, "left_semi").withColumn("_hash", F.xxhash64("text"))
    return _without(rest, again.toDF("doc_id", "text_hash")).unionByName(repeated.dropDuplicates(["doc_id", "_hash"]).drop("_hash"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark's passages."""
    texts = docs.select("doc_id", "text")
    judged = decontamination.contamination(texts, table(spark, sf_dir, "benchmark"))
    hashed = judged.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "contaminated")
    return _without(docs, hashed.filter("contaminated"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, and whether these decode to the text."""
    coded = pieces.encode_and_decode(docs)
    return coded.select(
        *docs.columns,
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: The classifier's fit is no SQL; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
