"""Tables that grow: versions of file tables, the similarity index, refreshes of what is new, the upsert stream."""

import json
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from entitylake.operators.fuzzy_join import similar_texts
from entitylake.operators.similarity_index import SimilarityIndex
from entitylake.plans import increments, jobs
from entitylake.sources.articles import ingest_articles
from entitylake.sources.store import LayerStore
from entitylake.streaming.articles import compact_articles, landed_stream, newest_articles, upsert_stream
from tests.test_fuzzy_join import texts

ENTITIES = """entity_name,entity_type,entity_description
Acme Corp,ORG,"Maker of rockets, run by Ada Stone in Rome."
Ada Stone,PERSON,"Head of Acme Corp."
Rome,GPE,"City where Acme Corps sits."
Acme Corps,ORG,"Nothing known."
"""

TABLES = (
    jobs.SILVER_ARTICLES, jobs.SILVER_ARTICLE_MENTIONS, jobs.SILVER_SENTIMENT, jobs.SILVER_SOURCE_MAPPING,
    jobs.GOLD_AFFILIATIONS, jobs.GOLD_MENTIONS, jobs.GOLD_SENTIMENT,
)


def bag(df, *without):
    df = df.drop(*without)
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def article(url, title, content, day="2024-05-09T10:00:00Z"):
    return {"url": url, "title": title, "description": "", "content": content, "author": None,
            "publishedAt": day, "source": {"name": "Daily"}}


def land(folder, name, entity, *articles):
    folder.mkdir(exist_ok=True)
    line = {"entity_uri": "", "entity_name": entity, "language": "en", "articles": list(articles)}
    (folder / name).write_text(json.dumps(line) + "\n")


@pytest.fixture
def store(spark, tmp_path):
    return LayerStore(spark, "parquet", str(tmp_path / "tables"))


def test_a_job_may_read_the_table_it_replaces(spark, store):
    store.write(spark.range(10).toDF("id"), "a.b")
    before = store.read("a.b")
    store.write(before.where("id > 4"), "a.b")
    assert bag(store.read("a.b")) == {(i,): 1 for i in range(5, 10)}
    assert before.count() == 10  # a reader keeps the version it began with
    assert store.version("a.b") == 2 and store.vacuum("a.b") == 1
    assert store.read("a.b").count() == 5


def test_a_write_that_fails_leaves_the_old_table(spark, store):
    store.write(spark.range(10).toDF("id"), "a.b")
    bad = spark.range(100, 200, 1, 4).select(F.when(F.col("id") == 199, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for mode in ("overwrite", "append"):
        with pytest.raises(PySparkException):
            store.write(bad, "a.b", mode=mode)
    assert store.read("a.b").count() == 10 and store.version("a.b") == 1


def test_what_was_added_after_a_version(spark, store):
    assert store.version("a.b") == 0 and store.sources("a.b") == {}
    for i in range(3):
        rows = spark.range(i, i + 1).select("id", F.lit("x").alias("p"))
        store.write(rows, "a.b", mode="append", partition_by=["p"] if i else [], sources={"x.y": i})
    assert bag(store.added("a.b", 1)) == {(1, "x"): 1, (2, "x"): 1}
    assert bag(store.added("a.b", 0, until=2)) == {(0, "x"): 1, (1, "x"): 1}
    assert store.added("a.b", 3) is None and store.sources("a.b") == {"x.y": 2}
    store.write(spark.range(1).toDF("id"), "a.b")
    with pytest.raises(ValueError):
        store.added("a.b", 2)
    with pytest.raises(ValueError):
        LayerStore(spark).version("a.b")


@pytest.mark.parametrize(("threshold", "options"), [(80, {"hot_rows": 3}), (70, {"hot_rows": 5, "chunk_rows": 4})])
def test_an_index_in_parts_has_the_pairs_of_all_texts(spark, store, threshold, options):
    values = texts(11, longest=80)
    index = SimilarityIndex(store, "index.t", threshold, **options)
    frames = [spark.createDataFrame([(v,) for v in part] + [(None,)], "t string") for part in (values[::3], values[1::3] + values[:9], values[2::3])]
    for frame in frames:
        index.add(frame, "t")
    whole = similar_texts(frames[0].unionByName(frames[1]).unionByName(frames[2]), None, "t", threshold)
    assert bag(index.pairs()) == bag(whole)
    assert index._read("texts").count() == len(values)
    other = spark.createDataFrame([(v,) for v in texts(12, longest=80)], "t string")
    assert bag(index.match(other, "t")) == bag(similar_texts(spark.createDataFrame([(v,) for v in values], "t string"), other, "t", threshold))


def test_old_texts_are_not_compared_again(spark, store):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "t string")
    index = SimilarityIndex(store, "index.t")
    index.add(frame("Acme Corp", "Acme Corps", "Zebra"), "t")
    assert index._read("pairs").count() == 1
    # Were old texts compared, their pair would come back.
    store.write(index._read("pairs").limit(0), "index.t_pairs")
    index.add(frame("Acme Corp.", "Zebras", "Acme Corp"), "t")
    found = {frozenset((r.left_text, r.right_text)) for r in index._read("pairs").collect()}
    assert found == {frozenset(p) for p in (("Acme Corp", "Acme Corp."), ("Acme Corps", "Acme Corp."), ("Zebra", "Zebras"))}


def refresh_inputs(folder, landing, moment):
    return jobs.Refresh(
        entity_files=str(folder / "known.csv"), landing=landing, as_of=date(2024, 5, 10),
        score=jobs.lexicon(["good"], ["bad"]), ingested_at=moment,
    )


def test_refresh_of_new_files_equals_a_refresh_of_all(spark, tmp_path):
    (tmp_path / "known.csv").write_text(ENTITIES)
    first, second = tmp_path / "first", tmp_path / "second"
    land(first, "1.json", "Acme Corp", article("u1", "Acme Corp wins", "A good day for Ada Stone."), article("u2", "Weather", "bad"))
    land(second, "2.json", "Acme Corp", article("u1", "Acme Corp wins", "A good day for Ada Stone, in Rome."),
         article("u4", "Acme Corps again", "good and bad"), article("u2", "Weather", "bad"))
    land(second, "3.json", "Rome", article("u3", "In Rome", "Rome is good, Acme Corps is bad and bad.", "soon"))
    moment = datetime(2024, 5, 10)
    parts = LayerStore(spark, "parquet", str(tmp_path / "parts"))
    jobs.refresh(parts, refresh_inputs(tmp_path, str(first), moment))
    inputs = refresh_inputs(tmp_path, str(second), moment)
    increments.refresh_new(parts, inputs)

    # The whole at once: the same files appended by two loads, then every step over all of it.
    whole = LayerStore(spark, "parquet", str(tmp_path / "whole"))
    jobs.load_articles(whole, str(first), inputs.as_of, ingested_at=moment)
    jobs.refresh(whole, inputs)
    for table in TABLES:
        got, wanted = bag(parts.read(table)), bag(whole.read(table))
        assert got == wanted and got, table

    # Nothing new: no step writes, so none has read an article.
    versions = {table: parts.version(table) for table in TABLES}
    inputs.landing = []
    increments.refresh_new(parts, inputs)
    assert versions == {table: parts.version(table) for table in TABLES}

    jobs.load_known_entities(parts, inputs.entity_files)
    with pytest.raises(ValueError):
        increments.refresh_new(parts, inputs)


def test_article_texts_are_compared_once(spark, tmp_path):
    (tmp_path / "known.csv").write_text(ENTITIES)
    landing = tmp_path / "landing"
    land(landing, "1.json", "Rome", article("u1", "Rome", "Acme Corp is good"))
    store = LayerStore(spark, "parquet", str(tmp_path / "tables"))
    inputs = refresh_inputs(tmp_path, str(landing), datetime(2024, 5, 10))
    jobs.refresh(store, inputs)
    for number in (2, 3):
        land(tmp_path / f"more{number}", "x.json", "Rome", article(f"u{number}", "Rome", "Acme Corp is good"))
        inputs.landing = str(tmp_path / f"more{number}")
        increments.refresh_new(store, inputs)
    assert store.read("silver.arriving_texts").count() == 0  # the third run saw known texts only
    uris = store.read(jobs.SILVER_SOURCE_MAPPING).groupBy("newsapi_uri").count().collect()
    assert len(uris) == 3 and len({r["count"] for r in uris}) == 1


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_stream_in_any_order_keeps_what_the_batch_keeps(spark, tmp_path, order):
    landing, moment = tmp_path / "landing", datetime(2024, 5, 10)
    files = [
        ("1.json", "Acme Corp", article("u1", "Old", "good"), article("u2", "Weather", "bad")),
        ("2.json", "Acme Corp", article("u1", "New", "good"), article("u9", "Long ago", "x", "2023-01-01T00:00:00Z")),
        ("3.json", "Rome", article("u1", "Old", "good"), article("u1", "Old", "good"), article("u3", "In Rome", "x", "soon")),
    ]
    store = LayerStore(spark, "parquet", str(tmp_path / "tables"))
    for i in order:
        land(landing, *files[i])
        upsert_stream(landed_stream(spark, str(landing), moment, 7, moment), store, "bronze.stream").awaitTermination()
    batch = bag(ingest_articles(spark, str(landing), moment, 7, moment))
    assert batch and bag(newest_articles(store, "bronze.stream")) == batch
    # A batch written twice changes nothing.
    store.write(store.read("bronze.stream").limit(2), "bronze.stream", mode="append")
    assert bag(newest_articles(store, "bronze.stream")) == batch
    compact_articles(store, "bronze.stream")
    assert bag(store.read("bronze.stream")) == batch
