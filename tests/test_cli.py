from entitylake.__main__ import parser, run
from entitylake.plans import jobs
from entitylake.sources.store import LayerStore


def test_jobs_and_report_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "k.csv").write_text(
        'entity_name,entity_type,entity_description\nAcme,ORG,"Owned by Zed Corp"\nZed Corp,ORG,"Owns Acme, Zed Corp"\n'
    )
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.json").write_text(
        '{"entity_name": "Acme", "language": "en", "articles": [{"title": "Zed Corp", "content": "good", '
        '"url": "u", "publishedAt": "2024-05-09T10:00:00Z", "source": {"name": "Daily"}}]}\n'
    )
    store = LayerStore(spark, "parquet", str(tmp_path / "lake"))
    for line in (
        f"known-entities --raw_data_filepath {tmp_path}/k.csv",
        f"articles --landing {tmp_path}/landing --as_of 2024-05-10 --days_back 3",
        "refine-entities",
        "refine-articles",
        "sentiment --positive good --negative bad",
        "mappings",
        "affiliations",
        "mentions",
        "article-sentiment",
        f"report top_entities_by_mentions --parameter entity_type=ORG --output {tmp_path}/top",
    ):
        run(parser().parse_args(line.split()), store)
    assert store.read(jobs.GOLD_SENTIMENT).first().sentiment_label == "POSITIVE"
    assert {r.entity_name for r in spark.read.parquet(f"{tmp_path}/top").collect()} == {"Acme", "Zed Corp"}
    run(parser().parse_args(["report", "sentiment_overview", "--parameter", "entity_name=Acme"]), store)
    assert "Acme" in capsys.readouterr().out
