"""Training, scoring, selection and the hostname model, on small settings."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from baitline.functions.urls import textual_host
from baitline.operators import metrics, models
from baitline.plans import catalog
from baitline.plans import inputs as i


@pytest.fixture(scope="module")
def parts(spark, folder):
    return [p.cache() for p in catalog._split_rows(spark, folder)]


def test_scores_and_missing_features(spark, parts):
    train, _, test = parts
    model = models.train_forest(train, numTrees=5, maxDepth=4)
    broken = test.withColumn("url_entropy", F.when(F.col("page_id") % 2 == 0, F.col("url_entropy")))
    rows = models.score_urls(broken, model).collect()
    for r in rows:
        assert r["available"] == (r["url_entropy"] is not None)
        assert (r["probability"] is None) == (not r["available"])
    importances = models.feature_importances(model)
    assert metrics.top_feature_importance(importances).count() == 15


def test_selection_takes_best_f1(parts):
    train, validation, test = parts
    options = {
        "Logistic Regression": lambda df, f: models.train_logreg(df, f, scale=True, max_iter=20),
        "Stump": lambda df, f: models.train_forest(df, f, numTrees=1, maxDepth=1),
    }
    _, table = models.select_and_refit(train, validation, test, options)
    rows = table.collect()
    best = max((r for r in rows if r["stage"] == "validation"), key=lambda r: r["f1"])["model"]
    assert [r["model"] for r in rows if r["stage"] == "test"] == [best]
    assert table.count() == 3


def test_ngram_vocabulary(spark):
    hosts = ["abab.com"] * 3 + ["abc.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    documents, terms = Counter(), Counter()
    for h in hosts:
        grams = [h[k:k + n] for n in (2, 3, 4, 5) for k in range(len(h) - n + 1)]
        terms.update(grams)
        documents.update(set(grams))
    got = {r["gram"]: (r["n_documents"], r["n_terms"]) for r in models.ngram_document_frequency(df).collect()}
    assert got == {g: (documents[g], terms[g]) for g in documents if documents[g] >= 3}


def test_hostname_model(spark, parts, tmp_path):
    train, validation, _ = parts
    model = models.train_hostname_model(train, max_iter=30)
    held = validation.withColumn("host", textual_host(F.col("url"))).select("url", "label", "host")
    scored = model.score(held)
    assert scored.count() == held.count()
    assert metrics.roc_auc(scored).first()["roc_auc"] > 0.8
    model.save(f"{tmp_path}/host")
    again = models.HostnameModel.load(spark, f"{tmp_path}/host").score(held)
    a = {(r["url"]): r["probability"] for r in scored.collect()}
    assert all(math.isclose(a[r["url"]], r["probability"]) for r in again.collect())
