"""Models of given coefficients, label polarity, class gaps and whole-URL lower-casing, by hand."""

import math

import pytest

from baitline.functions.urls import with_url_parts
from baitline.operators import metrics, models


def test_given_coefficients(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, 0.0, float("nan")), (4, 0.0, 0.0)], "id int, a double, b double")
    model = models.GivenLogistic({"a": 0.5, "b": -1.0}, 0.25)
    chance = 1 / (1 + math.exp(-(0.25 + 1.0 - 3.0)))
    for label, p in ((1, chance), (0, 1 - chance)):
        rows = {r["id"]: r for r in models.score_urls(df, model, ["a", "b"], positive_label=label).collect()}
        assert rows[1]["probability"] == pytest.approx(p)
        assert rows[1]["score"] == pytest.approx(100 * p)
        assert rows[1]["prediction"] == 0
        assert [rows[i]["available"] for i in (1, 2, 3, 4)] == [True, False, False, True]
        assert rows[2]["probability"] is None and rows[3]["prediction"] is None
        assert rows[2]["b"] == 1.0 and rows[2]["a"] is None


def test_polarity_mirrors(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 1, 0.7), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "label int, prediction int, probability double")
    mirrored = spark.createDataFrame([(1 - a, 1 - b, p) for a, b, p in rows], "label int, prediction int, probability double")
    assert models.evaluate(df) == pytest.approx(models.evaluate(mirrored, positive_label=0))
    assert sorted(metrics.classification_report(df).collect()) == sorted(metrics.classification_report(mirrored, positive_label=0).collect())
    cases = [t.selectExpr("'c' AS category", "'u' AS url", "label = prediction AS correct", "label AS expected", "prediction", "probability") for t in (df, mirrored)]
    for summary in (metrics.category_summary, metrics.category_prediction_matrix):
        assert sorted(summary(cases[0]).collect()) == sorted(summary(cases[1], positive_label=0).collect())
    assert [r["expected_label"] for r in metrics.failure_analysis(cases[0]).collect()] == [
        r["expected_label"] for r in metrics.failure_analysis(cases[1], positive_label=0).collect()]


def test_class_gaps(spark):
    rows = [(1, 4.0, 7, None), (1, 2.0, 7, 1.0), (0, 0.0, 7, None), (0, 1.0, 7, None)]
    df = spark.createDataFrame(rows, "label int, a double, same int, lost double")
    found = {r["feature"]: r["importance"] for r in models.class_gaps(df, ["a", "same", "lost"]).collect()}
    assert found == {"a": 0.625, "same": 0.0, "lost": 0.0}
    none = {r["feature"]: r["importance"] for r in models.class_gaps(df.where("label = 5"), ["a", "same"]).collect()}
    assert none == {"a": 0.0, "same": 0.0}


def test_whole_url_in_lower_case(spark):
    df = spark.createDataFrame([("HTTP://User@Ex.COM/A?B=C#D",), (None,)], "url string")
    first, lost = with_url_parts(df, lowercase_all=True).collect()
    assert (first["normalized_url"], first["path"], first["query"]) == ("http://user@ex.com/a?b=c#d", "/a", "b=c")
    assert lost["normalized_url"] is None
    assert with_url_parts(df).first()["path"] == "/A"
