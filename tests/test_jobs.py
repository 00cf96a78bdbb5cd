"""All jobs in order on a few files, and reports on the result."""

import json
from datetime import date, datetime

import pytest

from entitylake.plans import jobs
from entitylake.plans.reports import REPORTS
from entitylake.sources.store import LayerStore

ENTITIES = """entity_name,entity_type,entity_description
Acme Corp,ORG,"Maker of rockets, run by Ada Stone in Rome."
Ada Stone,PERSON,"Head of Acme Corp."
Rome,GPE,"City where Acme Corps sits."
Acme Corps,ORG,"Nothing known
about it."
"""


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    (folder / "known.csv").write_text(ENTITIES)
    landing = folder / "landing"
    landing.mkdir()

    def line(entity, *articles):
        return json.dumps({"entity_uri": "", "entity_name": entity, "language": "en", "articles": list(articles)})

    def article(url, title, content, day="2024-05-09T10:00:00Z"):
        return {"url": url, "title": title, "description": "", "content": content, "author": None,
                "publishedAt": day, "source": {"name": "Daily"}}

    (landing / "1.json").write_text(
        line("Acme Corp", article("u1", "Acme Corp wins", "A good day for Ada Stone."), article("u2", "Weather", "bad"))
        + "\n" + line("Rome", article("u3", "In Rome", "Rome is good, Acme Corps is bad and bad.", "soon"))
        + "\n"
    )
    store = LayerStore(spark, "parquet", str(folder / "tables"))
    inputs = jobs.Refresh(
        entity_files=str(folder / "known.csv"),
        landing=str(landing),
        as_of=date(2024, 5, 10),
        score=jobs.lexicon(["good"], ["bad"]),
        ingested_at=datetime(2024, 5, 10),
    )
    jobs.refresh(store, inputs)
    # A second run of the same window appends the articles again.
    jobs.load_articles(store, inputs.landing, inputs.as_of, ingested_at=datetime(2024, 5, 11))
    return store


def names(store):
    return {r.uri: r.entity_name for r in store.read(jobs.SILVER_ENTITIES).collect()}


def test_mentions(store):
    known = names(store)
    got = {(known[r.uri], r.entity_text, r.entity_type) for r in store.read(jobs.SILVER_ENTITY_MENTIONS).collect()}
    assert got == {
        ("Acme Corp", "Ada Stone", "PERSON"), ("Acme Corp", "Rome", "LOC"),
        ("Ada Stone", "Acme Corp", "ORG"), ("Rome", "Acme Corps", "ORG"),
    }


def test_affiliations_are_similar_description_mentions(store):
    rows = store.read(jobs.GOLD_FORWARD).collect()
    assert sorted((r.entity_name, r.affiliated_entity_name, r.match_details) for r in rows) == [
        ("Ada Stone", "Rome", "Acme Corp == Acme Corps"), ("Rome", "Ada Stone", "Acme Corps == Acme Corp"),
    ]
    complete = store.read(jobs.GOLD_AFFILIATIONS).collect()
    assert sorted((r.entity_name, r.match_details) for r in complete) == [
        ("Ada Stone", "Acme Corp == Acme Corps"), ("Ada Stone", "Acme Corps == Acme Corp"),
        ("Rome", "Acme Corp == Acme Corps"), ("Rome", "Acme Corps == Acme Corp"),
    ]


def test_article_mentions(store):
    rows = store.read(jobs.GOLD_MENTIONS).collect()
    assert sorted((r.entity_name, r.source_url, r.match_details) for r in rows) == [
        ("Acme Corp", "u1", "Ada Stone == Ada Stone"),
        ("Acme Corp", "u3", "Rome == Rome"),
        ("Ada Stone", "u1", "Acme Corp == Acme Corp"),
        ("Ada Stone", "u3", "Acme Corp == Acme Corps"),
        ("Rome", "u1", "Acme Corps == Acme Corp"),
        ("Rome", "u3", "Acme Corps == Acme Corps"),
    ]
    assert {r.source_published_at for r in rows if r.source_url == "u3"} == {None}


def test_sentiment(store):
    rows = {r.title: (r.sentiment_label, round(r.sentiment_score, 4)) for r in store.read(jobs.GOLD_SENTIMENT).collect()}
    assert rows == {
        "Acme Corp wins": ("POSITIVE", 1.0), "Weather": ("NEGATIVE", 1.0), "In Rome": ("NEGATIVE", 0.3333)
    }


def test_append_and_deduplication(store):
    assert store.read(jobs.BRONZE_ARTICLES).count() == 6
    jobs.refine_articles(store, dedupe_articles=True)
    rows = store.read(jobs.SILVER_ARTICLES).collect()
    assert len(rows) == 3 and {r.ingestion_timestamp for r in rows} == {datetime(2024, 5, 11)}


def test_reports_run_on_the_written_tables(store):
    tables = jobs.report_tables(store)
    top = REPORTS["top_entities_by_mentions"](tables).collect()
    assert [(r.entity_name, r.mention_count) for r in top] == [("Acme Corp", 2), ("Ada Stone", 2), ("Rome", 2)]
    pairs = REPORTS["pair_sentiment"](tables, min_co_mentions=1).collect()
    assert {(r.entity1, r.entity2, r.co_mentions) for r in pairs} == {
        ("Acme Corp", "Ada Stone", 2), ("Acme Corp", "Rome", 2), ("Ada Stone", "Rome", 2)
    }
