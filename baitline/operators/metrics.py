"""Classification metrics and behaviour summaries over prediction tables.

Prediction tables have ``label`` (0/1), ``prediction`` (0/1) and ``probability``.
``positive_label`` says which label counts as positive; scores are read as the
probability of that label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.operators.ranking import running_totals

# Names of the negative and the positive class.
CLASS_NAMES = ("Legitimate", "Phishing")


def _rate(part: Column, whole: Column) -> Column:
    """Quotient with 0.0 for an empty denominator."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion_counts(df: DataFrame, by: list[str] | None = None, positive_label: int = 1) -> DataFrame:
    truth, guess = F.col("label") == positive_label, F.col("prediction") == positive_label
    return df.groupBy(*(by or [])).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth & ~guess).alias("fn"),
    )


def binary_metrics(df: DataFrame, by: list[str] | None = None, positive_label: int = 1) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one aggregation."""
    c = confusion_counts(df, by, positive_label)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        *(by or []), "tp", "fp", "tn", "fn",
        _rate(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _rate(tp, tp + fp).alias("precision"),
        _rate(tp, tp + fn).alias("recall"),
        _rate(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def _score_totals(df: DataFrame, score: str, positive_label: int, buckets: int) -> DataFrame:
    """Positives and negatives per distinct score, with those at lower scores."""
    per_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col("label") == positive_label).alias("pos"),
        F.count_if(F.col("label") != positive_label).alias("neg"),
    )
    return running_totals(per_score, "score", ["pos", "neg"], buckets)


def roc_auc(df: DataFrame, score: str = "probability", positive_label: int = 1, buckets: int = 64) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null for a single class."""
    t = _score_totals(df, score, positive_label, buckets)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") * 0.5))
    pos, neg = F.sum("pos"), F.sum("neg")
    return t.agg(
        pos.alias("n_pos"), neg.alias("n_neg"),
        (wins / F.nullif((pos.cast("double") * neg), F.lit(0.0))).alias("roc_auc"),
    )


def average_precision(df: DataFrame, score: str = "probability", positive_label: int = 1, buckets: int = 64) -> DataFrame:
    """Exact step-wise average precision; null without positives."""
    scored = df.withColumn("_neg_score", -F.col(score))
    t = _score_totals(scored, "_neg_score", positive_label, buckets)
    tp = F.col("before_pos") + F.col("pos")
    seen = tp + F.col("before_neg") + F.col("neg")
    return t.agg(
        F.sum("pos").alias("n_pos"),
        (F.sum(F.col("pos") * tp / seen) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("average_precision"),
    )


def classification_report(df: DataFrame, names: tuple[str, str] = CLASS_NAMES, positive_label: int = 1) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows.

    Everything derives from one row of confusion counts. ``names`` are those of the negative and the positive class.
    """
    c = confusion_counts(df, positive_label=positive_label)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))

    def one(hit: Column, wrongly: Column, missed: Column, name: str) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"),
            _rate(hit, hit + wrongly).alias("precision"),
            _rate(hit, hit + missed).alias("recall"),
            _rate(hit * 2, hit * 2 + wrongly + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = c.withColumns({"_c0": one(tn, fn, fp, names[0]), "_c1": one(tp, fp, fn, names[1])})
    n0, n1 = F.col("_c0.support"), F.col("_c1.support")
    n = n0 + n1

    def mean(metric: str, weighted: bool) -> Column:
        a, b = F.col(f"_c0.{metric}"), F.col(f"_c1.{metric}")
        return (_rate(a * n0 + b * n1, n) if weighted else (a + b) / 2).alias(metric)

    accuracy = _rate(tp + tn, n)
    rows = F.array(
        F.col("_c0"), F.col("_c1"),
        F.struct(F.lit("accuracy").alias("class_name"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), n.alias("support")),
        *[
            F.struct(F.lit(label).alias("class_name"), *[mean(m, w) for m in ("precision", "recall", "f1")], n.alias("support"))
            for label, w in (("macro avg", False), ("weighted avg", True))
        ],
    )
    return classes.select(F.explode(rows).alias("r")).select("r.*")


def category_summary(cases: DataFrame, positive_label: int = 1) -> DataFrame:
    """Correct, total, accuracy, mean probability and predicted classes per category.

    The ``ALL`` row comes from the same pass (rollup).
    """
    return cases.rollup("category").agg(
        F.count_if(F.col("correct")).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.avg("probability").alias("mean_probability"),
        F.count_if(F.col("prediction") == positive_label).alias("predicted_phishing"),
        F.count_if(F.col("prediction") != positive_label).alias("predicted_legitimate"),
    ).withColumn("category", F.coalesce("category", F.lit("ALL")))


def category_prediction_matrix(cases: DataFrame, positive_label: int = 1) -> DataFrame:
    """Predicted classes per category side by side, highest mean probability first."""
    return cases.groupBy("category").agg(
        F.count_if(F.col("prediction") != positive_label).alias("LEGITIMATE"),
        F.count_if(F.col("prediction") == positive_label).alias("PHISHING"),
        F.avg("probability").alias("mean_probability"),
    ).orderBy(F.desc("mean_probability"), "category")


def failure_analysis(cases: DataFrame, positive_label: int = 1) -> DataFrame:
    """Misjudged cases with readable labels."""
    def named(c: str) -> Column:
        return F.when(F.col(c) == positive_label, "PHISHING").otherwise("LEGITIMATE")

    return (
        cases.where(~F.col("correct"))
        .withColumns({"expected_label": named("expected"), "predicted_label": named("prediction")})
        .orderBy("category", "url")
    )


def model_comparison(results: DataFrame) -> DataFrame:
    """Models by descending F1 (ties by name), the winner flagged."""
    best = results.agg(F.max_by("model", F.struct(F.col("f1"), F.col("model"))).alias("_best"))
    winner = best.withColumn("_one", F.lit(1))
    joined = results.withColumn("_one", F.lit(1)).join(F.broadcast(winner), "_one")
    return joined.withColumn("selected", F.col("model") == F.col("_best")).drop("_one", "_best").orderBy(
        F.desc("f1"), F.desc("model")
    )


def best_configurations(results: DataFrame, k: int = 10) -> DataFrame:
    return results.orderBy(F.desc("f1"), "feature_set", "model").limit(k)


def top_feature_importance(importances: DataFrame, k: int = 15) -> DataFrame:
    """Highest-ranked rows of a (feature, importance) table."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


