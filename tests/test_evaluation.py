import pytest

from entitylake.operators.evaluation import (
    average_counts,
    extraction_metrics,
    metric_averages,
    predicted_counts,
    text_accuracy,
)


@pytest.fixture(scope="module")
def data(spark):
    truth = spark.createDataFrame(
        [("1", 2, 2, 1), ("2", 1, 0, 1), ("3", 2, 2, 1)], "uid string, persons int, org int, loc int"
    )
    mentions = spark.createDataFrame(
        [("1", "a", "PERSON"), ("1", "b", "PERSON"), ("1", "c", "PERSON"), ("1", "d", "ORG"),
         ("2", "e", "ORG"), ("2", "f", "LOC")],
        "uid string, entity_text string, entity_type string",
    )
    return truth, mentions


def test_counts(data):
    rows = {r.uid: (r.PERSON, r.ORG, r.LOC) for r in predicted_counts(data[1]).collect()}
    assert rows == {"1": (3, 1, 0), "2": (0, 1, 1)}


def test_metrics(data):
    rows = {r.uid: r for r in extraction_metrics(*data).collect()}
    assert set(rows) == {"1", "2"}  # a text without mentions is left out
    one, two = rows["1"], rows["2"]
    assert (one.PERSON_precision, one.PERSON_recall, one.PERSON_f1) == (1.0, 1.0, 1.0)
    assert one.PERSON_precision_strict == pytest.approx(2 / 3)
    assert (one.ORG_precision, one.ORG_recall) == (1.0, 0.5)
    assert one.ORG_f1 == pytest.approx(2 * 0.5 / 1.5)
    assert (one.LOC_precision, one.LOC_recall, one.LOC_f1) == (0.0, 0.0, 0.0)
    assert (two.ORG_precision, two.ORG_recall, two.ORG_f1) == (0.0, 0.0, 0.0)


def test_averages(data):
    rows = {r.entity_type: r for r in metric_averages(extraction_metrics(*data)).collect()}
    assert rows["PERSON"].precision == 0.5 and rows["ORG"].recall == 0.25
    assert rows["OVERALL"].precision == pytest.approx((0.5 + 0.5 + 0.5) / 3)


def test_accuracy_counts_texts_without_mentions(data):
    rows = {r.uid: (r.PERSON_accuracy, r.ORG_accuracy, r.LOC_accuracy) for r in text_accuracy(*data).collect()}
    assert rows == {"1": (0.5, 0.5, 0.0), "2": (0.0, 0.0, 1.0), "3": (0.0, 0.0, 0.0)}


def test_average_counts(data):
    rows = {r.entity_type: (r.labelled, r.predicted) for r in average_counts(*data).collect()}
    assert rows["PERSON"] == (pytest.approx(5 / 3), 1.5) and rows["LOC"] == (1.0, 0.5)
