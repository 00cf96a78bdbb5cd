"""Article ingest as files land.

The same flattening as the batch ingest, run continuously: look-back windows
that overlap bring the same article again, and here it is dropped as long as
its first sighting is within the watermark.
"""

from __future__ import annotations

from datetime import datetime
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entitylake.schemas import ARTICLE_RESPONSE, ARTICLES
from entitylake.session import shared_folder
from entitylake.sources.articles import flatten_responses, in_language, in_window, one_per_key
from entitylake.sources.store import LayerStore


def article_stream(
    spark: SparkSession, landing: str, keep_for: str = "8 days", days_back: int | None = None
) -> DataFrame:
    """Articles from new files in ``landing``, each key once within ``keep_for``.

    With ``days_back`` the window of the batch ingest applies, up to the day a file is read.
    """
    responses = spark.readStream.schema(ARTICLE_RESPONSE).json(landing)
    flat = flatten_responses(responses, F.current_timestamp())
    if days_back is None:
        recent = flat.where(in_language())
    else:
        recent = in_window(flat, F.current_timestamp(), days_back)
    return (
        recent.withWatermark("ingestion_timestamp", keep_for)
        .dropDuplicatesWithinWatermark(["uri"])
        .select(*ARTICLES.names)
    )


def append_stream(articles: DataFrame, target: str, name: str = "articles") -> StreamingQuery:
    """Append to a Parquet folder what has landed, then stop; run it again for more.

    Progress is kept in the shared folder, apart for each target.
    """
    folder = shared_folder(articles.sparkSession)
    progress = f"{folder}/{name}-{sha256(target.encode()).hexdigest()[:16]}"
    return (
        articles.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(target)
    )


def landed_stream(
    spark: SparkSession, landing: str, as_of: datetime | None = None, days_back: int = 7, ingested_at: datetime | None = None
) -> DataFrame:
    """Every article of new files in ``landing`` that the batch ingest would take, repeated ones included.

    ``as_of`` and ``ingested_at`` are the day and time a file is read unless given.
    """
    responses = spark.readStream.schema(ARTICLE_RESPONSE).json(landing)
    moment = F.current_timestamp() if ingested_at is None else F.lit(ingested_at)
    flat = flatten_responses(responses, moment)
    return in_window(flat, F.current_timestamp() if as_of is None else F.lit(as_of), days_back).select(*ARTICLES.names)


def upsert_stream(articles: DataFrame, store: LayerStore, table: str) -> StreamingQuery:
    """Keep the newest article of each key of what has landed in a file table, then stop; run it again for more.

    A batch appends its own newest rows, and :func:`newest_articles` folds them when the table is read. So the
    order in which files or batches come does not matter, nor does a batch that is written twice
    after a failure, and no state grows with the keys. :func:`compact_articles` folds the table itself.
    """
    folder = shared_folder(articles.sparkSession)
    progress = f"{folder}/upsert-{sha256(f'{store.root} {table}'.encode()).hexdigest()[:16]}"

    def merge(batch: DataFrame, number: int) -> None:
        store.write(one_per_key(batch), table, mode="append")

    return (
        articles.writeStream.foreachBatch(merge)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def newest_articles(store: LayerStore, table: str) -> DataFrame:
    """One row per key of a table that :func:`upsert_stream` fills: what the batch ingest keeps of the same files."""
    return one_per_key(store.read(table))


def compact_articles(store: LayerStore, table: str) -> None:
    """Replace the table by its newest rows; readers have the old version until the new one is whole."""
    store.write(newest_articles(store, table), table)
    store.vacuum(table)
