"""A refresh that works on what is new since the last one.

Each table remembers, in the same commit as its rows, which versions of its
sources it was made from. A step reads what its sources have got since and appends what
follows from that, so a step that failed is simply run again, and a run without new
articles reads none. The known entities stay as the last full refresh loaded them: with another dictionary every
mention may change, which is the full refresh's work. So is one article per key, as it takes rows away.

Mentions are distinct per article, so those already listed are left out. Mapping rows follow from pairs of
texts: only article texts that have never been compared meet the stored index of the
known ones. The published table of mentions joins mapping and articles, and what is new in it is
new articles with the whole mapping and older ones with new rows of the mapping.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.operators.fuzzy_join import _with_keys
from entitylake.operators.similarity_index import SimilarityIndex
from entitylake.plans import jobs, layers
from entitylake.plans.reports import ReportTables
from entitylake.sources.store import LayerStore

KNOWN_INDEX = "silver.known_texts"
TEXT_PAIRS = "silver.entity_to_source_texts"
COMPARED = "silver.compared_texts"


def _now(store: LayerStore, *tables: str) -> dict[str, int]:
    """Versions that a step works with: what comes later is left for the next run."""
    return {table: store.version(table) for table in tables}


def _new(store: LayerStore, target: str, source: str, now: dict[str, int]) -> DataFrame | None:
    """Rows of ``source`` up to now that ``target`` has not seen."""
    return store.added(source, store.sources(target).get(source, 0), now[source])


def _append(store: LayerStore, target: str, rows: DataFrame, sources: dict[str, int]) -> None:
    store.write(rows, target, mode="append", sources=sources)


def _not_in(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows that a table does not have, nulls being equal."""
    same = None
    for column in rows.columns:
        equal = rows[column].eqNullSafe(table[column])
        same = equal if same is None else same & equal
    return rows.join(table, same, "left_anti")


def refine_new_articles(store: LayerStore, extract: jobs.Extraction | None = None) -> None:
    now = _now(store, jobs.BRONZE_ARTICLES, jobs.BRONZE_ENTITIES)
    if (new := _new(store, jobs.SILVER_ARTICLES, jobs.BRONZE_ARTICLES, now)) is not None:
        _append(store, jobs.SILVER_ARTICLES, new, now)
    if (new := _new(store, jobs.SILVER_ARTICLE_MENTIONS, jobs.BRONZE_ARTICLES, now)) is not None:
        found = (extract or jobs.gazetteer_of(store))(new, "uri", list(jobs.ARTICLE_TEXTS))
        # Only articles that came again can have mentions that are listed.
        again = store.read(jobs.SILVER_ARTICLE_MENTIONS).join(new.select("uri").distinct(), "uri", "left_semi")
        _append(store, jobs.SILVER_ARTICLE_MENTIONS, _not_in(found, again), now)


def score_new_articles(store: LayerStore, score: jobs.Scoring) -> None:
    now = _now(store, jobs.SILVER_ARTICLES)
    if (new := _new(store, jobs.SILVER_SENTIMENT, jobs.SILVER_ARTICLES, now)) is not None:
        scored = score(new.select("uri", "title", "content"))
        columns = ["uri", "title", "sentiment_score", "sentiment_label"]
        _append(store, jobs.SILVER_SENTIMENT, scored.select(*columns), now)


def known_index(store: LayerStore, threshold: float) -> SimilarityIndex:
    """Index of the known entities' mention texts, made anew when these have changed."""
    index = SimilarityIndex(store, KNOWN_INDEX, threshold)
    version = store.version(jobs.SILVER_ENTITY_MENTIONS)
    if store.sources(f"{KNOWN_INDEX}_pairs").get(jobs.SILVER_ENTITY_MENTIONS) != version:
        index.rebuild(store.read(jobs.SILVER_ENTITY_MENTIONS), "entity_text", (jobs.SILVER_ENTITY_MENTIONS,))
        none = store.spark.createDataFrame([], "left_text string, right_text string, score double")
        store.write(none, TEXT_PAIRS)
        store.write(store.spark.createDataFrame([], "text string"), COMPARED)
    return index


def map_new_articles(store: LayerStore, threshold: float = 80) -> None:
    """Mapping rows of new mentions; only texts that were never compared are."""
    now = _now(store, jobs.SILVER_ENTITY_MENTIONS, jobs.SILVER_ARTICLE_MENTIONS)
    new = _new(store, jobs.SILVER_SOURCE_MAPPING, jobs.SILVER_ARTICLE_MENTIONS, now)
    if new is None:
        return
    index = known_index(store, threshold)
    texts = new.select(F.col("entity_text").alias("text")).distinct()
    unseen = texts.join(store.read(COMPARED), "text", "left_anti")
    store.write(unseen, "silver.arriving_texts")
    unseen = store.read("silver.arriving_texts")
    store.write(index.match(unseen, "text"), TEXT_PAIRS, mode="append")
    store.write(unseen, COMPARED, mode="append")
    # A pair is listed once more if a run failed before its texts were.
    pairs = store.read(TEXT_PAIRS).distinct().join(texts.withColumnRenamed("text", "right_text"), "right_text", "left_semi")
    rows = _with_keys(pairs, store.read(jobs.SILVER_ENTITY_MENTIONS), new, "entity_text", "uri")
    _append(store, jobs.SILVER_SOURCE_MAPPING, layers.mapping_rows(rows), now)


def publish_new_mentions(store: LayerStore) -> None:
    now = _now(store, jobs.SILVER_SOURCE_MAPPING, jobs.SILVER_ENTITIES, jobs.SILVER_ARTICLES)
    articles = _new(store, jobs.GOLD_MENTIONS, jobs.SILVER_ARTICLES, now)
    mapping = _new(store, jobs.GOLD_MENTIONS, jobs.SILVER_SOURCE_MAPPING, now)
    older = store.added(jobs.SILVER_ARTICLES, 0, until=store.sources(jobs.GOLD_MENTIONS).get(jobs.SILVER_ARTICLES, 0))
    entities = store.read(jobs.SILVER_ENTITIES)
    parts = []
    if articles is not None:
        parts.append(layers.entity_articles(store.read(jobs.SILVER_SOURCE_MAPPING), entities, articles))
    if mapping is not None and older is not None:
        # New rows of the mapping are mostly about new articles: the older ones are narrowed to the rest.
        older = older.join(mapping.select(F.col("newsapi_uri").alias("uri")).distinct(), "uri", "left_semi")
        parts.append(layers.entity_articles(mapping, entities, older))
    if parts:
        _append(store, jobs.GOLD_MENTIONS, reduce(DataFrame.unionByName, parts), now)


def publish_new_sentiment(store: LayerStore) -> None:
    now = _now(store, jobs.SILVER_ARTICLES, jobs.SILVER_SENTIMENT)
    if (new := _new(store, jobs.GOLD_SENTIMENT, jobs.SILVER_SENTIMENT, now)) is None:
        return
    changed = new.select("uri").distinct()
    narrowed: Callable[[str], DataFrame] = lambda name: store.read(name).join(changed, "uri", "left_semi")
    rows = layers.article_sentiment(
        narrowed(jobs.SILVER_ARTICLES).select("uri", "title"), narrowed(jobs.SILVER_SENTIMENT)
    )
    _append(store, jobs.GOLD_SENTIMENT, _not_in(rows, narrowed(jobs.GOLD_SENTIMENT)), now)


def refresh_new(store: LayerStore, inputs: jobs.Refresh) -> ReportTables:
    """As :func:`~entitylake.plans.jobs.refresh` after newly landed files, on a file store that has had a full refresh.

    ``inputs.landing`` names the new files; without any, only steps that are behind run.
    """
    if inputs.dedupe_articles:
        raise ValueError("one article per key takes rows away: run the full refresh")
    if store.sources(jobs.SILVER_ARTICLES).get(jobs.BRONZE_ENTITIES) != store.version(jobs.BRONZE_ENTITIES):
        raise ValueError("the known entities have changed, or there was no refresh yet: run the full refresh")
    if inputs.landing:
        jobs.load_articles(store, inputs.landing, inputs.as_of, inputs.days_back, inputs.ingested_at)
    refine_new_articles(store, inputs.extract)
    score_new_articles(store, inputs.score)
    map_new_articles(store, inputs.threshold)
    publish_new_mentions(store)
    publish_new_sentiment(store)
    return jobs.report_tables(store)
