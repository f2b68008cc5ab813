"""Toxicity on held-out labels, and mixing rates against their targets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baitline.llm import mixing, samples, toxicity
from baitline.llm.words import runs

MEDIUM = "/root/testdata/sf0.1"
ODD = [(-1, None), (-2, ""), (None, "plain words"), (-3, "word " * 30_000), (-1, None)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")


def test_toxicity_on_held_out_labels(spark, tables):
    docs, labels = tables
    model = toxicity.fit_on(docs, labels)
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r for r in rows if r.toxic == t] for t in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    odd = toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit(2)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in scored.filter("predicted = 0").collect()}


def test_toxicity_without_labels(spark):
    docs, none = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def plain_logit(model, text):
    """Embedding, convolution, pooling and the logistic layer, one word and filter at a time."""
    (run,) = runs(pa.array([text]))
    ids = toxicity.word_buckets(run)[0].astype(int)
    best = np.zeros(len(model.bias))
    for at in range(len(ids)):
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                k = (w - 1) * toxicity.FILTERS + f
                total = model.bias[k]
                for o in range(w):
                    column = toxicity._OFFSETS.index((w, o)) * toxicity.FILTERS + f
                    if at + o < len(ids):
                        total += sum(model.mapped[i, column] for i in ids[at + o])
                best[k] = max(best[k], total)
    return sum(b * x for b, x in zip(best, model.weights, strict=True)) + model.intercept


@pytest.mark.parametrize("slices", [1 << 16, 5])
def test_logits_against_plain_loops(monkeypatch, slices):
    rng = np.random.default_rng(3)
    wide, total = len(toxicity._OFFSETS) * toxicity.FILTERS, len(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Classifier(
        rng.normal(0, 1, (toxicity.BUCKETS, wide)).astype(np.float32), rng.normal(0, 1, total).astype(np.float32), rng.normal(0, 1, total).astype(np.float32), 0.3,
    )
    monkeypatch.setattr(toxicity, "SLICE_WORDS", slices)
    texts = ["one", "", "two words", "the quick brown fox jumps over the lazy dog und der Hund", None, "a b c d e f g h i j k. l, m!", "x " * 31]
    got = np.concatenate([model.logits(run, toxicity._function_table())[0] for run in runs(pa.array(texts))])
    assert np.allclose(got, [plain_logit(model, t or "") if (t or "").split() else np.zeros(total) @ model.weights + 0.3 for t in texts], atol=1e-3)


def test_long_labelled_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 60)
    long = "calm neutral words " * 12_000
    rows = [(i, long + ("vile " if i % 2 else "kind ") * 30 + long if i < 6 else ("vile awful " if i % 2 else "kind nice ") * 20) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels)
    assert sample.filter("length(text) > 100000").count() >= 2
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit_on(docs, labels)).collect()}
    assert sum(found[i] == i % 2 for i in range(120)) >= 114


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "w" * (10 + i)) for i in range(50)] + [(99, "z" * 5000)], "doc_id long, text string")
    found = samples.labelled(docs, spark.createDataFrame([(i, i % 2) for i in range(50)] + [(99, 0)], "doc_id long, label int"))
    rows = samples.draw(docs, found, {0: 5, 1: 100}, 1000).collect()
    assert sum(len(r.text) for r in rows) <= 1000 and 99 not in {r.doc_id for r in rows} and sum(r.label == 0 for r in rows) == 5 <= sum(r.label for r in rows)


def test_held_out_labels_are_not_learned(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    ids = lambda x: sorted(r.doc_id for r in toxicity.training_sample(docs, x).select("doc_id").collect())
    assert ids(labels) == ids(flipped)


def test_rates_meet_targets(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("rate", F.lit(0))
    weights = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
    rows = mixing.mixing_rates(docs, labels, weights).collect()
    assert len(rows) == docs.count() and min(r.rate for r in rows) >= 0
    n = np.array([r.n_tokens for r in rows], float)
    p, rate = np.array([[r.good, r.poor, r.toxic] for r in rows]), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1)
    got = (n * rate) @ p / n.sum()
    assert np.allclose(got, list(weights.values()), atol=1e-3)


def members(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 900, 300)
    return p, n, spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")


@pytest.mark.parametrize("weights", [{"good": 0.6, "poor": 0.3, "toxic": 0.1}, {"good": 0.88, "poor": 0.12}, {"good": 0.1, "poor": 0.1, "toxic": 0.8}])
def test_targets_are_met_at_floor_one(spark, weights):
    p, n, frame = members(spark)
    fit = mixing.fit_rates(frame, weights, 1.0)
    rates = np.array([r.rate for r in frame.withColumn("rate", mixing.rate(F.col("posterior"), fit.steps, 1.0)).orderBy("doc_id").collect()])
    listed = [mixing.DOMAINS.index(d) for d in weights]
    got = ((n * rates) @ p)[listed]
    assert rates.min() >= 1 and np.allclose(got / got.sum(), list(weights.values()), atol=1e-3) and fit.residual < 1e-3


def test_missed_targets_are_told(spark):
    frame = spark.createDataFrame([(1, 100, [1.0, 0.0, 0.0]), (2, 50, [1.0, 0.0, 0.0])], "doc_id long, n_tokens long, posterior array<double>")
    assert mixing.fit_rates(frame, {"good": 0.5, "poor": 0.5}, 1.0).residual == pytest.approx(0.5)
    assert mixing.fit_rates(frame.limit(0), {"good": 0.5, "poor": 0.5}, 1.0).residual == 0


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_steps_against_numpy(spark, floor):
    p, n, frame = members(spark)
    steps = mixing.fit_steps(frame, {"good": 0.6, "poor": 0.3, "toxic": 0.1}, floor)
    rates = np.array([r.rate for r in frame.withColumn("rate", mixing.rate(F.col("posterior"), steps, floor)).orderBy("doc_id").collect()])
    held = n @ p / n.sum()
    want = np.array([0.6, 0.3, 0.1]) * (1 if floor == 0 else (held / np.array([0.6, 0.3, 0.1])).max())
    missed = lambda r: ((n * r) @ p / n.sum() - want) @ np.linalg.inv((p * n[:, None]).T @ p / n.sum()) @ ((n * r) @ p / n.sum() - want)
    assert rates.min() >= floor
    if floor == 0:
        assert np.allclose((n * rates) @ p / n.sum(), want, atol=1e-3)
    # no small change of the rates that the floor allows comes closer
    for seed in range(50):
        step = np.random.default_rng(seed).normal(0, 0.05, len(rates))
        assert missed(rates) <= missed(np.maximum(floor, rates + step)) + 2e-2


def test_copies_and_columns(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    out = mixing.mixed(docs, labels, {"good": 0.7, "poor": 0.3})
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == docs.count() <= out.count()
    draws = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(draws[0] - 1.3) < 0.02 and (draws[1], draws[2]) == (1, 2)


def test_mixing_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert mixing.mixing_rates(docs.limit(0), none, {"good": 1.0}).collect() == []
    assert len(mixing.mixing_rates(docs, none, {"good": 0.5, "poor": 0.5}).collect()) == len(ODD)
