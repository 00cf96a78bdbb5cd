import json
from datetime import date, datetime
from uuid import uuid4

import pytest

from entitylake.session import shared_folder
from entitylake.sources.articles import (
    flatten_responses,
    in_window,
    ingest_articles,
    most_relevant,
    one_per_key,
    read_responses,
)
from entitylake.sources.entities import read_entity_files, read_labelled_texts
from entitylake.sources.store import LayerStore, sample
from entitylake.streaming.articles import append_stream, article_stream

NOW = datetime(2024, 5, 10, 12)


def test_entity_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'entity_name,entity_type,entity_description\n'
        'Ada,PERSON,"Wrote, first, programs"\n'
        'Rome,LOC,"Old\ncity"\n'
    )
    # The last quote is never closed.
    (tmp_path / "b.csv").write_text(
        'entity_name,entity_type,entity_description\nTerra,ORG,"Reactor company, developing\n'
    )
    rows = {r.entity_name: r for r in read_entity_files(spark, f"{tmp_path}/*.csv").collect()}
    assert rows["Ada"].entity_description == "Wrote, first, programs"
    assert rows["Rome"].entity_description == "Old\ncity"
    assert rows["Terra"].entity_description.startswith("Reactor company, developing")
    assert len(rows) == 3


def test_labelled_texts(spark, tmp_path):
    (tmp_path / "l.csv").write_text('data,persons,org,loc\n"Ada met Bob, in Rome",2,0,1\n')
    row = read_labelled_texts(spark, str(tmp_path / "l.csv")).first()
    assert (row.data, row.persons, row.org, row.loc, len(row.uid)) == ("Ada met Bob, in Rome", 2, 0, 1, 64)


def article(n, published="2024-05-09T10:00:00Z", **changes):
    base = {
        "title": f"t{n}", "description": "d", "content": "c", "url": f"u{n}", "author": "x",
        "publishedAt": published, "source": {"name": "Daily"},
    }
    return {**base, **changes}


def land(folder, name, entity, articles, language="en"):
    line = {"entity_uri": f"id-{entity}", "entity_name": entity, "language": language, "articles": articles}
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(line) + "\n")


def test_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "1.json", "Ada", [
        article(1),
        article(1, content="other copy"),  # same url and title: the same article
        article(2, published="yesterday"),
        article(3, published="2024-05-02T00:00:00Z"),
        article(4, title=None, source=None),
        article(5, published="2024-05-03T00:00:00Z"),
        article(6, published="2024-05-11T00:00:00Z"),
        article(7, source={"name": None}),
    ])
    land(landing, "2.json", "Bob", [article(1)])
    land(landing, "3.json", "Cid", [article(9)], language="fr")
    rows = ingest_articles(spark, str(landing), date(2024, 5, 10), 7, NOW).collect()
    assert sorted((r.entity_name, r.url) for r in rows) == [
        ("Ada", "u1"), ("Ada", "u2"), ("Ada", "u4"), ("Ada", "u5"), ("Ada", "u7"), ("Bob", "u1")
    ]
    by_url = {(r.entity_name, r.url): r for r in rows}
    assert by_url["Ada", "u1"].uri != by_url["Bob", "u1"].uri
    assert by_url["Ada", "u1"].published_at == datetime(2024, 5, 9, 10)
    assert by_url["Ada", "u2"].published_at is None
    assert by_url["Ada", "u4"].source_name == "" and by_url["Ada", "u4"].title is None
    assert by_url["Ada", "u7"].source_name is None
    assert by_url["Ada", "u1"].ingestion_timestamp == NOW
    # Which copy stays does not depend on the order of rows.
    flat = flatten_responses(read_responses(spark, str(landing)), NOW)
    again = one_per_key(flat.orderBy("content", ascending=False).repartition(5)).where("url = 'u1' and entity_name = 'Ada'")
    assert again.first().content == by_url["Ada", "u1"].content == "other copy"


def test_every_article_of_every_response_is_kept(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "1.json", "Ada", [article(n) for n in range(100)])
    land(landing, "2.json", "Ada", [article(n) for n in range(100, 200)])
    land(landing, "3.json", "Bob", [article(n) for n in range(20)])
    rows = ingest_articles(spark, str(landing), date(2024, 5, 10), 7, NOW).collect()
    assert {r.url for r in rows if r.entity_name == "Ada"} == {f"u{n}" for n in range(200)}
    assert sum(r.entity_name == "Bob" for r in rows) == 20
    # A page size, if asked for, holds within a response.
    pages = ingest_articles(spark, str(landing), date(2024, 5, 10), 7, NOW, per_response=60).collect()
    assert sum(r.entity_name == "Ada" for r in pages) == 120
    flat = flatten_responses(read_responses(spark, str(landing)), NOW)
    assert in_window(most_relevant(flat, 1), NOW, 7).count() == 3


def test_table_options_reach_the_reader(spark, tmp_path):
    store = LayerStore(spark, "csv", str(tmp_path), {"header": "true"}, {"a.b": {"header": "false"}})
    store.write(spark.createDataFrame([("x",)], "name string"), "a.b")
    store.write(spark.createDataFrame([("x",)], "name string"), "a.c")
    assert store.read("a.b").columns == ["_c0"]
    assert store.read("a.c").columns == ["name"]
    assert store.read("a.b", header="true").columns == ["name"]


@pytest.mark.parametrize("kind", ["table", "parquet"])
def test_store(spark, tmp_path, kind):
    store = LayerStore(spark, kind, None if kind == "table" else str(tmp_path))
    df = spark.createDataFrame([(2, "b"), (1, "a")], "x int, s string")
    seen = store.write(df, f"layer_{kind}.things", sort_by=["x"])
    assert seen.get["rows"] == 2
    store.write(df.limit(1), f"layer_{kind}.things", mode="append")
    assert store.read(f"layer_{kind}.things").count() == 3
    store.write(df, f"layer_{kind}.things")
    assert sorted(r.x for r in store.read(f"layer_{kind}.things").collect()) == [1, 2]
    assert sample(df, 1).count() == 1


def test_store_without_folder(spark):
    with pytest.raises(ValueError):
        LayerStore(spark, "parquet").read("a.b")


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stream_drops_what_overlapping_windows_repeat(spark, tmp_path):
    # A name of its own: the session's shared folder outlives the test.
    landing, target = tmp_path / "landing", str(tmp_path / f"articles-{uuid4().hex}")

    def run():
        append_stream(article_stream(spark, str(landing)), target).awaitTermination(120)

    land(landing, "1.json", "Ada", [article(1), article(1), article(2)])
    run()
    land(landing, "2.json", "Ada", [article(2), article(3)])
    land(landing, "3.json", "Bob", [article(3)], language="de")
    run()
    rows = spark.read.parquet(target).collect()
    assert sorted(r.url for r in rows) == ["u1", "u2", "u3"]
