"""Edge cases of the reports that the large tables do not have."""

from datetime import datetime

import pytest

from entitylake.plans.reports import REPORTS, ReportTables

MENTION = (
    "entity_uri string, entity_name string, entity_type string, entity_description string, source_uri string, "
    "source_title string, source_description string, source_url string, source_name string, "
    "source_published_at timestamp, match_details string, match_score double"
)
AFFILIATION = (
    "entity_name string, entity_type string, entity_description string, affiliated_entity_name string, "
    "affiliated_entity_type string, affiliated_entity_description string, match_score double"
)


def day(text):
    return datetime.fromisoformat(text) if text else None


def tables(spark, mentions=(), affiliations=(), sentiment=()):
    return ReportTables(
        affiliations=spark.createDataFrame(
            [(a, ta, a, b, tb, b, float(s)) for a, ta, b, tb, s in affiliations], AFFILIATION
        ),
        mentions=spark.createDataFrame(
            [(e, e, t, e, u, u, u, u, s, day(d), "m", score) for e, t, u, s, d, score in mentions], MENTION
        ),
        sentiment=spark.createDataFrame(
            list(sentiment), "uri string, title string, sentiment_score float, sentiment_label string"
        ),
    )


def run(name, given, **parameters):
    return [tuple(r) for r in REPORTS[name](given, **parameters).collect()]


def test_articles_without_a_date(spark):
    given = tables(
        spark,
        [("a", "ORG", "1", "s", None, 80.0), ("a", "ORG", "2", "s", "2024-05-08", 90.0)],
        sentiment=[("1", "t", 0.5, "POSITIVE"), ("2", "t", 0.25, "NEUTRAL")],
    )
    assert run("affiliations_over_time", given, entity_name="a") == [(day("2024-05-01"), 1, 90.0)]
    assert run("news_relevance_over_time", given, entity_name="a") == [(day("2024-05-06"), 1, 90.0), (None, 1, 80.0)]
    trend = run("sentiment_trend", given)
    assert [(r[0], r[1], r[2]) for r in trend] == [(day("2024-05-01"), 1, 0.25), (None, 1, 0.5)]
    # Bounds are inclusive and leave out what has no date.
    assert len(run("entity_news_sources", given, entity_name="a", date_from="2024-05-08", date_to="2024-05-08")) == 1


def test_velocity_across_a_gap_and_ties_at_the_top(spark):
    given = tables(
        spark,
        [(e, "ORG", f"{e}{i}", "s", d, 80.0) for e in ("b", "a", "c") for i, d in enumerate(
            ["2024-01-05", "2024-01-06", "2024-04-01"])],
    )
    rows = run("mention_velocity", given, top_n_entities=2)
    assert rows == [
        (day("2024-01-01"), "a", 2, None, 2, None), (day("2024-01-01"), "b", 2, None, 2, None),
        (day("2024-04-01"), "a", 1, 2, -1, -50.0), (day("2024-04-01"), "b", 1, 2, -1, -50.0),
    ]


def test_moving_average_is_over_days_with_mentions(spark):
    given = tables(
        spark, [("a", "ORG", str(i), "s", f"2024-01-{1 + 3 * i:02d}", 80.0) for i in range(9)] + [
            ("a", "ORG", "x", "s", "2024-01-25", 80.0)]
    )
    rows = run("mention_trends", given, top_n_entities=1)
    assert [r[2] for r in rows] == [1] * 8 + [2]
    assert rows[-1][3] == pytest.approx(8 / 7)


def test_correlation_without_variance(spark):
    scores = {"1": 0.5, "2": 0.5, "3": 0.75, "4": 0.25}
    mentions = [("a", "ORG", "1", "s1", None, 80.0), ("a", "ORG", "2", "s2", None, 80.0),
                ("b", "ORG", "3", "s1", None, 80.0), ("b", "ORG", "4", "s2", None, 80.0),
                ("c", "ORG", "3", "s1", None, 80.0), ("c", "ORG", "4", "s2", None, 80.0),
                ("d", "ORG", "4", "s2", None, 80.0)]
    given = tables(spark, mentions, sentiment=[(u, "t", s, "NEUTRAL") for u, s in scores.items()])
    rows = run("sentiment_correlation", given, min_common_sources=1)
    assert [(r[0], r[1], r[2], r[4]) for r in rows] == [("b", "c", 2, "Strong Positive")]
    assert rows[0][3] == pytest.approx(1.0)
    # One source: no deviation, and an unknown one sorts first among equals.
    contrast = {r[0]: r for r in run("sentiment_contrast", given, min_sources=1)}
    assert contrast["d"][3] is None and contrast["b"][3] == pytest.approx(0.353553, abs=1e-5)


def test_repeated_articles_multiply_pairs(spark):
    """Rows are counted, not articles: 2 x 3 mention rows and two sentiment rows of one article."""
    mentions = [("a", "ORG", "1", "s", "2024-01-01", 80.0)] * 2 + [("b", "LOC", "1", "s", "2024-01-01", 80.0)] * 3
    given = tables(spark, mentions, sentiment=[("1", "t", 0.5, "POSITIVE"), ("1", "t", 0.25, "NEGATIVE")])
    row = run("pair_sentiment", given, min_co_mentions=1)
    assert row == [("a", "b", 12, 0.375, 6, 0, 6, 50.0, 0.0, 50.0)]
    assert run("pair_sentiment", given, min_co_mentions=1, entity_type="PERSON") == []
    assert run("relationships_by_sentiment", given, min_co_mentions=1, entity_type="LOC")[0][-4] == "Neutral"
    assert run("related_entities", given) == []  # in one article only


def test_pairs_of_one_entity(spark):
    mentions = [(e, "ORG", u, "s", "2024-01-01", 80.0) for u, es in (("1", "abc"), ("2", "bc"), ("3", "ab")) for e in es]
    given = tables(spark, mentions)
    month = day("2024-01-01")
    assert run("pair_mention_trends", given, entity_name="a") == [(month, "a", "b", 2, 1), (month, "a", "c", 1, 2)]
    assert run("pair_mention_trends", given) == [
        (month, "a", "b", 2, 1), (month, "b", "c", 2, 1), (month, "a", "c", 1, 3)]


def test_median_of_even_and_repeated_scores(spark):
    mentions = [("a", "ORG", str(i), "s", "2024-01-01", s) for i, s in enumerate([80.0, 80.0, 90.0, 100.0, None])]
    mentions += [("a", "ORG", "x", "s", "2024-02-01", 85.0)]
    given = tables(spark, mentions)
    assert run("match_score_trends", given) == [
        (day("2024-01-01"), 87.5, 85.0, 80.0, 100.0), (day("2024-02-01"), 85.0, 85.0, 85.0, 85.0)]


def test_comparison_of_one_sided_affiliations(spark):
    given = tables(
        spark,
        affiliations=[("a", "ORG", "x", "LOC", 90), ("a", "ORG", "y", "LOC", 80), ("b", "ORG", "y", "LOC", 85),
                      ("b", "ORG", "z", "PERSON", 95)],
    )
    assert run("affiliation_comparison", given, entity_name_1="a", entity_name_2="b") == [
        ("y", "LOC", 80.0, 85.0, "With both entities"), ("x", "LOC", 90.0, None, "Only with a"),
        ("z", "PERSON", None, 95.0, "Only with b")]


def test_emerging_relationships_without_history(spark):
    affiliations = [("a", "ORG", "x", "LOC", 90), ("a", "ORG", "x", "LOC", 80), ("b", "LOC", "x", "LOC", 85)]
    mentions = [("a", "ORG", "1", "s", "2024-05-01", 80.0), ("b", "LOC", "2", "s", "2024-05-01", 80.0),
                ("b", "LOC", "3", "s", "2024-01-01", 80.0), ("b", "LOC", "4", "s", "2024-01-02", 80.0)]
    given = tables(spark, mentions, affiliations)
    rows = run("emerging_relationships", given, recent_period_days=30, historical_period_days=365, as_of="2024-05-10")
    assert rows == [("a", "x", 2, 0, 2, None), ("b", "x", 1, 2, -1, -50.0)]
    only = run("emerging_relationships", given, recent_period_days=30, historical_period_days=365,
               as_of="2024-05-10", entity_type="LOC")
    assert [r[0] for r in only] == ["b"]


def test_clusters_and_comparison_with_itself(spark):
    mentions = [("a", "ORG", str(i), "s", "2024-01-01", 80.0) for i in range(5)]
    sentiment = [(str(i), "t", 0.75, "POSITIVE" if i else "NEGATIVE") for i in range(5)]
    given = tables(spark, mentions, sentiment=sentiment)
    assert run("sentiment_clusters", given, min_mentions=1)[0][-1] == "Highly Positive"
    rows = run("sentiment_comparison", given, entity_name_1="a", entity_name_2="a")
    assert [r[0] for r in rows] == ["Entity 1", "Entity 2"] and rows[0][1:] == rows[1][1:]


def test_rewritten_self_joins_against_the_literal_ones(spark):
    import random

    rng = random.Random(9)
    types = {name: rng.choice(["ORG", "LOC", "PERSON"]) for name in "abcdefg"}
    affiliations = [
        (x, types[x], y, types[y], rng.choice([80, 90, 100]))
        for x, y in (rng.choices("abcdefg", k=2) for _ in range(120))
    ]
    given = tables(spark, affiliations=affiliations)
    given.affiliations.createOrReplaceTempView("aff")
    literal = spark.sql(
        """SELECT x.entity_name, y.affiliated_entity_name, avg(x.match_score), count(*) FROM aff x JOIN aff y
           ON x.affiliated_entity_name = y.affiliated_entity_name AND x.entity_name <> y.entity_name
           AND x.entity_name <> y.affiliated_entity_name AND y.entity_name <> x.affiliated_entity_name
           WHERE x.entity_type = 'ORG' GROUP BY 1, 2 HAVING count(*) > 1
           ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 20"""
    ).collect()
    got = run("similar_entities", given, entity_type="ORG")
    assert [(a, b, round(s, 6), n) for a, b, s, n in got] == [(a, b, round(s, 6), n) for a, b, s, n in literal]
    literal = spark.sql(
        """SELECT x.entity_type, y.affiliated_entity_type, count(*) FROM aff x JOIN aff y
           ON x.entity_name = y.entity_name AND x.entity_type <> y.affiliated_entity_type GROUP BY 1, 2"""
    ).collect()
    assert sorted(run("entity_type_correlation", given)) == sorted(map(tuple, literal))
