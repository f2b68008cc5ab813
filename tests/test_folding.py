"""Model fits on folded rows: every row counts, equal rows cost one."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from baitline.operators import joins, models

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """4,000 rows of 20 kinds."""
    kind = F.col("id") % 20
    return spark.range(4000).select((kind % 5).cast("int").alias("a"), (kind * 0.5).alias("b"), (kind > 8).cast("int").alias("label"))


@pytest.fixture
def trained_on(monkeypatch):
    """The tables that fits pack for training."""
    seen, packed = [], models._packed
    monkeypatch.setattr(models, "_packed", lambda t: seen.append(t.collect()) or packed(t))
    return seen


@pytest.mark.parametrize(("fit", "options", "weight", "most"), [
    (models.train_forest, {"numTrees": 3, "maxDepth": 4}, "weight", 20 * 8),
    (models.train_boosted, {"maxIter": 3, "maxDepth": 3}, "weight", 20 * 8),
    (models.train_logreg, {"max_iter": 5}, "n", 20),
])
def test_equal_rows_fold_and_all_count(rows, trained_on, fit, options, weight, most):
    model = fit(rows, NAMES, **options)
    (table,) = trained_on
    assert len(table) <= most
    assert math.isclose(sum(r[weight] for r in table), 4000)
    assert models.score_urls(rows, model, NAMES).where("available").count() == 4000


def test_folded_logistic_fit_is_that_of_all_rows(rows):
    got = models.train_logreg(rows, NAMES, max_iter=200).stages[-1]
    weighted, n = models.balanced_weights(VectorAssembler(inputCols=NAMES, outputCol="vector").transform(rows))
    want = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=200, regParam=1.0 / n, standardization=False
    ).fit(weighted)
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), rel=1e-3)


@pytest.mark.parametrize("rare", [-1000.0, 1000.0])
def test_a_value_apart_from_the_quantiles_keeps_its_bin(spark, rare):
    """One row in fifty differs from a value that fills all quantiles, from above or from below, by many values."""
    x = F.when(F.col("id") % 50 == 0, F.lit(rare) + F.col("id") / 100).otherwise(5.0)
    df = spark.range(5000).select(x.alias("x"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    model = models.train_forest(df, ["x"], numTrees=3, maxDepth=3)
    scored = models.score_urls(df, model, ["x"])
    assert scored.where("prediction <> label").count() == 0


def test_bins_stay_ordered(rows):
    """A split of a tree is a threshold, not a set of bins."""
    tree = models.train_forest(rows, NAMES, numTrees=2, maxDepth=2).stages[-1].toDebugString
    assert " <= " in tree and " in {" not in tree


def test_one_row_per_case(spark):
    cases = spark.createDataFrame([("u", 1), ("u", 0), ("v", 1), ("w", 1)], "url string, expected int")
    predictions = spark.createDataFrame([("u", 1, 0.9), ("u", 0, 0.2), ("v", 0, 0.1)], "url string, prediction int, probability double")
    got = sorted((r["url"], r["expected"], r["prediction"], r["correct"]) for r in joins.score_cases(cases, predictions).collect())
    assert got == [("u", 0, 1, False), ("u", 1, 1, True), ("v", 1, 0, False)]


def test_steps_of_the_hostname_fit_send_no_more_than_the_data_grow(spark, monkeypatch):
    """What a step sends is bounded by the cells, however many partitions the table has."""
    for cells, width in ((10**6, 10**5), (10**9, 10**6), (10**11, 10**6)):
        parts = models.fit_partitions(cells, width)
        assert parts == models.LEAST_PARTITIONS or parts * width * models.CELLS_PER_COEFFICIENT <= cells or parts <= cells / models.CELLS_PER_PARTITION + 1
    seen = []

    class Spy(LogisticRegression):
        def fit(self, table):
            seen.append(table.rdd.getNumPartitions())
            return super().fit(table)

    monkeypatch.setattr(models, "LogisticRegression", Spy)
    urls = spark.range(400).select(F.concat(F.lit("http://h"), F.col("id") % 40, F.lit(".example/")).alias("url"), (F.col("id") % 2).alias("label"))
    models.train_hostname_model(urls.repartition(32), max_iter=2)
    assert seen == [models.LEAST_PARTITIONS]
