"""Training, selection and scoring of the URL and hostname models with Spark ML."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from baitline.functions import urls as ur
from baitline.functions.fixed_values import FEATURE_NAMES
from baitline.functions.shipping import ship_with_tasks
from baitline.operators import metrics
from baitline.operators.dedup import union_for_refit
from baitline.operators.ranking import chunked_row_number
from baitline.session import cut_lineage

ship_with_tasks(__name__)

# Hyper-parameters of the published models, and the ablation sets.
ITERATIONS = 2000
FOREST = {"numTrees": 300, "maxDepth": 18, "minInstancesPerNode": 2}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
BOOSTED_LARGE = {"maxIter": 400, "maxDepth": 8, "stepSize": 0.08, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9",
                 "minInstancesPerNode": 2}
BOOSTED_HISTOGRAM = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.08}
NGRAM_SIZES = (2, 3, 4, 5)
MIN_DOCUMENTS = 3
HOST_C = 3.0
SEED = 42
ROWS_PER_PARTITION = 20_000
# Bins a feature has in tree training (the default of Spark's trees), and the rows that a group of equal rows is dealt to.
BINS = 32
UNITS = 8
# A step of the hostname fit sends one number per coefficient and partition: least partitions, and the cells a partition
# has for each coefficient and at most.
LEAST_PARTITIONS = 4
CELLS_PER_COEFFICIENT = 64
CELLS_PER_PARTITION = 50_000_000
ABLATION_SETS = {
    "ALL_FEATURES": [],
    "NO_HTTPS": ["has_https"],
    "NO_HTTPS_PATH": ["has_https", "path_length"],
    "NO_SHORTCUTS": ["has_https", "path_length", "slash_count"],
}


def balanced_weights(
    df: DataFrame, label: str = "label", weight: str = "weight", rows: str | None = None,
) -> tuple[DataFrame, int]:
    """Append class weights n / (2 * class size) and return the table with its row count.

    The class sizes (one number per label) come from one count. With ``rows`` each row stands for that many.
    """
    each = F.col(rows) if rows else F.lit(1)
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.sum(each).alias("n")).collect()}
    total = sum(sizes.values())
    value = F.lit(1.0)
    for name, n in sizes.items():
        value = F.when(F.col(label) == name, total / (len(sizes) * n)).otherwise(value)
    return df.withColumn(weight, value * each), total


@contextmanager
def held(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """Keep tables that are read several times; lost blocks are recomputed by Spark."""
    kept = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables]
    try:
        yield kept
    finally:
        for t in kept:
            t.unpersist()


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` (kept) in partitions of about ROWS_PER_PARTITION, since every step of a fit runs a task for each."""
    return rows.coalesce(max(1, -(-rows.count() // ROWS_PER_PARTITION)))


def _folded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` and label with their number ``n``; in a fixed order, so that a seed gives one model."""
    return rows.groupBy(*columns, "label").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*columns, "label")


_COMMON = {"featuresCol": "vector", "labelCol": "label"}


def train_logreg(df: DataFrame, features: list[str] | None = None, scale: bool = False, max_iter: int = ITERATIONS, c: float = 1.0) -> PipelineModel:
    """Balanced logistic regression with an L2 penalty of strength 1 / c per training row.

    Equal rows enter the loss as one row with their number as weight; the scaler sees every row.
    """
    names = features or FEATURE_NAMES
    stages: list[Estimator] = [VectorAssembler(inputCols=names, outputCol="raw_vector" if scale else "vector", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True))
    prepared = Pipeline(stages=stages).fit(df)
    with held(_folded(df, names)) as (rows,):
        weighted, n = balanced_weights(_packed(rows), rows="n")
        classifier = LogisticRegression(
            **_COMMON, weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), standardization=False
        )
        return PipelineModel(stages=[*prepared.stages, classifier.fit(prepared.transform(weighted))])


class Bins(Transformer):
    """Appends the bin of each feature as a plain number, so that trees take it as ordered and not as a category."""

    def __init__(self, bucketizer: Bucketizer):
        super().__init__()
        self.bucketizer, self.codes = bucketizer, bucketizer.getOutputCols()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.bucketizer.transform(dataset).withColumns({c: F.col(c) + F.lit(0.0) for c in self.codes})


def _bins(rows: DataFrame, names: list[str]) -> Bins:
    """The bins of tree training, BINS a feature, taken from all rows: each value its own bin, or quantiles of many values.

    A value that fills the upper quantiles keeps a bin of its own, as one that fills the lower ones does.
    """
    value = {n: F.col(n).cast("double") for n in names}
    seen = rows.agg(
        F.struct(*[F.approx_count_distinct(n).alias(n) for n in names]).alias("kinds"),
        F.struct(*[F.max(value[n]).alias(n) for n in names]).alias("highest"),
    ).first()
    few = [n for n in names if seen["kinds"][n] <= 1.25 * BINS]
    values = rows.agg(*[F.sort_array(F.collect_set(value[n])).alias(n) for n in few]).first() if few else {}
    many = [n for n in names if n not in few or len(values[n]) > BINS]
    cuts = dict(zip(many, rows.approxQuantile(many, [k / BINS for k in range(1, BINS)], 0.1 / BINS) if many else []))
    filled = [n for n in many if seen["highest"][n] in cuts[n]]
    second = rows.agg(*[F.max(F.when(value[n] < seen["highest"][n], value[n])).alias(n) for n in filled]).first() if filled else {}
    splits = []
    for n in names:
        if n in cuts:
            inner = {q for q in cuts[n] if q < seen["highest"][n]} | ({second[n]} if n in filled else set())
            edges = [math.nextafter(q, math.inf) for q in sorted(inner)]
        else:
            edges = [(a + b) / 2 for a, b in zip(values[n], values[n][1:])] or values[n] or [0.0]
        splits.append([-math.inf, *edges, math.inf])
    return Bins(Bucketizer(inputCols=names, outputCols=[f"{n}_bin" for n in names], splitsArray=splits, handleInvalid="error"))


def _fit_trees(classifier: Estimator, df: DataFrame, names: list[str], balanced: bool) -> PipelineModel:
    """Fit trees on rows folded by their bins.

    Trees see a feature through its bins only, so rows of equal bins and label are one row with their number as weight.
    Bootstraps and row samples draw rows one by one; more than UNITS equal rows are dealt to UNITS rows of equal weight,
    which keeps every row's weight and makes a draw move at most 1 / UNITS of a group at a time.
    """
    with held(df.select(*names, "label")) as (rows,):
        bins = _bins(rows, names)
        codes = bins.codes
        units = F.least(F.col("n"), F.lit(UNITS)).cast("int")
        dealt = _folded(bins.transform(rows), codes).select(*codes, "label", F.explode(F.array_repeat(F.col("n") / units, units)).alias("weight"))
        with held(dealt) as (training,):
            packed = _packed(training)
            if balanced:
                packed = balanced_weights(packed, rows="weight")[0]
            vector = VectorAssembler(inputCols=codes, outputCol="vector", handleInvalid="error")
            return PipelineModel(stages=[bins, vector, classifier.fit(vector.transform(packed))])


def train_forest(df: DataFrame, features: list[str] | None = None, **options) -> PipelineModel:
    """Balanced random forest."""
    classifier = RandomForestClassifier(**_COMMON, weightCol="weight", seed=SEED, **{**FOREST, **options})
    return _fit_trees(classifier, df, features or FEATURE_NAMES, balanced=True)


def train_boosted(df: DataFrame, features: list[str] | None = None, **options) -> PipelineModel:
    """Gradient-boosted trees with shrinkage and row and column sampling."""
    classifier = GBTClassifier(**_COMMON, weightCol="weight", seed=SEED, **{**BOOSTED, **options})
    return _fit_trees(classifier, df, features or FEATURE_NAMES, balanced=False)


# Fits that run at a time.
FITS_AT_ONCE = 8

Trainer = Callable[[DataFrame, list[str]], PipelineModel]
TRAINERS: dict[str, Trainer] = {
    "Logistic Regression": lambda df, f: train_logreg(df, f),
    "Random Forest": lambda df, f: train_forest(df, f),
    "Boosted Trees": lambda df, f: train_boosted(df, f),
}


class GivenLogistic(Transformer):
    """A logistic model of given coefficients, such as one that was fitted elsewhere."""

    def __init__(self, weights: dict[str, float], bias: float = 0.0):
        super().__init__()
        self.weights, self.bias = weights, bias

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = sum((F.col(n) * F.lit(float(w)) for n, w in self.weights.items()), F.lit(float(self.bias)))
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return dataset.withColumns({
            "probability": array_to_vector(F.array(1.0 - chance, chance)), "prediction": (chance > 0.5).cast("double"),
        })


def score_urls(
    df: DataFrame, model: PipelineModel | Transformer, features: list[str] | None = None, positive_label: int = 1,
) -> DataFrame:
    """Append ``available``, ``prediction``, ``probability`` (of ``positive_label``) and ``score`` (percent).

    A row with a missing feature is answered with ``available`` false and nulls; it
    never stops the job.
    """
    names = features or FEATURE_NAMES
    usable = F.lit(True)
    for n in names:
        value = F.col(n).cast("double")
        usable = usable & value.isNotNull() & ~F.isnan(value)
    ready = df.withColumn("available", usable)
    filled = ready.withColumns({f"_f{i}": F.col(n) for i, n in enumerate(names)}).na.fill(0, names)
    out = model.transform(filled).withColumn("_p", vector_to_array("probability")[positive_label])
    restored = [F.col(f"_f{names.index(c)}").alias(c) if c in names else F.col(c) for c in df.columns]
    shown = lambda e: F.when(F.col("available"), e)
    return out.select(
        *restored, "available",
        shown(F.col("prediction").cast("int")).alias("prediction"),
        shown(F.col("_p")).alias("probability"),
        shown(F.col("_p") * 100.0).alias("score"),
    )


def evaluate(scored: DataFrame, positive_label: int = 1) -> dict[str, float]:
    """Accuracy, precision, recall, F1, ROC AUC and average precision of a scored table."""
    base = metrics.binary_metrics(scored, positive_label=positive_label).first()
    auc = metrics.roc_auc(scored, positive_label=positive_label).first()["roc_auc"]
    ap = metrics.average_precision(scored, positive_label=positive_label).first()["average_precision"]
    return {
        "accuracy": base["accuracy"], "precision": base["precision"], "recall": base["recall"], "f1": base["f1"],
        "roc_auc": auc, "pr_auc": ap,
        "true_negative": base["tn"], "false_positive": base["fp"], "false_negative": base["fn"], "true_positive": base["tp"],
    }


RESULT_SCHEMA = (
    "model string, accuracy double, precision double, recall double, f1 double, roc_auc double, pr_auc double, "
    "true_negative long, false_positive long, false_negative long, true_positive long, "
    "train_seconds double, predict_seconds double, ms_per_row double, stage string"
)


def _measured(name: str, stage: str, trainer: Trainer, train: DataFrame, unseen: DataFrame, features: list[str]):
    started = time.perf_counter()
    model = trainer(train, features)
    trained = time.perf_counter()
    with held(score_urls(unseen, model, features)) as (scored,):
        n = scored.count()
        done = time.perf_counter()
        values = evaluate(scored)
    row = {
        "model": name, **values, "train_seconds": trained - started, "predict_seconds": done - trained,
        "ms_per_row": (done - trained) * 1000.0 / n if n else None, "stage": stage,
    }
    return model, row


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]], at_once: int | None = None) -> list[object]:
    """Results of independent jobs in their order, so many of them at a time.

    The many short stages of one fit leave most of a cluster idle; other fits fill it.
    """
    with ThreadPoolExecutor(max_workers=at_once or FITS_AT_ONCE) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))


def select_and_refit(
    train: DataFrame, validation: DataFrame, test: DataFrame, trainers: dict[str, Trainer] | None = None,
    features: list[str] | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fit every model, keep the best validation F1, refit it on both splits, test once.

    Of models with one F1 the last by name is kept, as in ``metrics.model_comparison``.
    Returns the refitted model and a table of validation rows plus one test row.
    """
    trainers, names = trainers or TRAINERS, features or FEATURE_NAMES
    spark = train.sparkSession
    with held(train, validation) as kept:
        rows = side_by_side(spark, [partial(_measured, name, "validation", fit, *kept, names) for name, fit in trainers.items()])
        rows = [row for _, row in rows]
        best = max(rows, key=lambda r: (r["f1"], r["model"]))["model"]
        model, row = _measured(best, "test", trainers[best], union_for_refit(*kept), test, names)
    return model, spark.createDataFrame([*rows, row], RESULT_SCHEMA)


def ablation(
    train: DataFrame, validation: DataFrame, trainers: dict[str, Trainer] | None = None,
    sets: dict[str, list[str]] | None = None, features: list[str] | None = None,
) -> DataFrame:
    """Validation metrics for every (feature set, model) pair; the fits run side by side on one kept table.

    Trainers are listed from the cheapest to the dearest; the dearest start first, so that none is left alone at the end.
    """
    trainers, names = trainers or TRAINERS, features or FEATURE_NAMES
    spark = train.sparkSession
    grid = [(s, [f for f in names if f not in dropped], m) for m in reversed(list(trainers)) for s, dropped in (sets or ABLATION_SETS).items()]
    with held(*(t.select(*names, "label") for t in (train, validation))) as both:
        for table in both:
            table.count()
        fitted = side_by_side(spark, [partial(_measured, m, "validation", trainers[m], *both, kept) for _, kept, m in grid])
    rows = [{"feature_set": s, **row} for (s, _, _), (_, row) in zip(grid, fitted, strict=True)]
    return spark.createDataFrame(rows, "feature_set string, " + RESULT_SCHEMA)


def feature_importances(model: PipelineModel, features: list[str] | None = None) -> DataFrame:
    """(feature, importance) rows of a tree model; empty for other models."""
    names = features or FEATURE_NAMES
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else []
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def class_gaps(df: DataFrame, features: list[str] | None = None, positive_label: int = 1) -> DataFrame:
    """(feature, importance) without a model: how far the class means lie apart, as a share of the feature's range.

    To six decimals; 0.0 for a constant feature or where a class is missing. One aggregation over all features; values
    are summed to nine decimals, exactly, so that the order of rows does not matter.
    """
    names = features or FEATURE_NAMES
    positive = F.col("label") == positive_label

    def gap(name: str) -> Column:
        x = F.col(name).cast("decimal(28,9)")
        mean = lambda member: F.sum(F.when(member, x)).cast("double") / F.nullif(F.count_if(member & x.isNotNull()), F.lit(0))
        spread = F.max(x).cast("double") - F.min(x).cast("double")
        return F.round(F.coalesce(F.abs(mean(positive) - mean(~positive)) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)), 6)

    wide = df.agg(*[gap(n).alias(n) for n in names])
    return wide.unpivot([], names, "feature", "importance")


# --- hostname model -------------------------------------------------------------------

def ngrams(host: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """All character n-grams of a host, in order, shorter ones first."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(host) - (n - 1))
        pieces = F.transform(starts, lambda i: F.substr(host, i, F.lit(n)))
        return F.when(F.length(host) >= n, pieces).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in sizes])


def host_grams(df: DataFrame, host: str = "host", sizes: tuple[int, ...] = NGRAM_SIZES, keys: list[str] | None = None) -> DataFrame:
    """keys, gram, tf: n-grams of each distinct host with their count in it."""
    keys = keys or [host]
    exploded = df.select(*keys, F.explode(ngrams(F.col(host), sizes)).alias("gram"))
    return exploded.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("tf"))


def ngram_document_frequency(
    df: DataFrame, host: str = "host", sizes: tuple[int, ...] = NGRAM_SIZES,
    min_df: int = MIN_DOCUMENTS, max_size: int | None = None,
) -> DataFrame:
    """gram, n_documents, n_terms: the character n-gram vocabulary of a host column.

    Every input row is a document. Equal hosts are folded first with their row count,
    so n-grams are generated once per host and a hot host costs no more than a rare
    one. ``max_size`` keeps the most frequent n-grams only; without it none is left out.
    """
    per_host = df.where(F.col(host) != "").groupBy(host).agg(F.count(F.lit(1)).alias("n"))
    grams = host_grams(per_host, host, sizes, keys=[host, "n"])
    vocabulary = grams.groupBy("gram").agg(
        F.sum("n").alias("n_documents"), F.sum(F.col("n") * F.col("tf")).alias("n_terms")
    ).where(F.col("n_documents") >= min_df)
    if max_size is None:
        return vocabulary
    return vocabulary.orderBy(F.desc("n_terms"), "gram").limit(max_size)


class HostnameModel:
    """Vocabulary weights of a linear TF-IDF model, applied with joins.

    ``weights`` has one row per n-gram of the vocabulary: (gram, idf, coefficient).
    """

    def __init__(self, weights: DataFrame, intercept: float, sizes: tuple[int, ...] = NGRAM_SIZES):
        self.weights, self.intercept, self.sizes = weights, intercept, sizes

    def score(self, df: DataFrame, host: str = "host") -> DataFrame:
        """Append ``available``, ``probability`` and ``prediction`` per row.

        Distinct hosts are scored once and joined back; the weight table grows with the
        vocabulary, so adaptive execution chooses its join by measured size.
        """
        hosts = df.where(F.col(host) != "").select(F.col(host).alias("_host")).distinct()
        grams = host_grams(hosts, "_host", self.sizes)
        value = (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf")
        known = grams.join(self.weights, "gram").withColumn("_x", value)
        sums = known.groupBy("_host").agg(
            F.sum(F.col("_x") * F.col("coefficient")).alias("_dot"), F.sum(F.col("_x") * F.col("_x")).alias("_square")
        )
        margin = F.coalesce(F.col("_dot") / F.nullif(F.sqrt("_square"), F.lit(0.0)), F.lit(0.0)) + F.lit(self.intercept)
        scored = hosts.join(sums, "_host", "left").select(
            "_host", (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("probability")
        )
        joined = df.join(scored, F.col(host) == F.col("_host"), "left").drop("_host")
        return joined.withColumns({
            "available": F.col("probability").isNotNull(),
            "prediction": F.when(F.col("probability").isNotNull(), (F.col("probability") > 0.5).cast("int")),
        })

    def save(self, path: str) -> None:
        self.weights.withColumn("intercept", F.lit(self.intercept)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, sizes: tuple[int, ...] = NGRAM_SIZES) -> HostnameModel:
        table = spark.read.parquet(path)
        return HostnameModel(table.drop("intercept"), table.first()["intercept"], sizes)


def fit_partitions(cells: int, width: int) -> int:
    """Partitions for a linear fit of ``cells`` non-zero values and ``width`` coefficients.

    Each step of the fit sends ``width`` numbers per partition. Beyond LEAST_PARTITIONS a partition has
    CELLS_PER_COEFFICIENT cells for each of them, so what is sent grows with the cells, not with partitions times
    vocabulary; only partitions of over CELLS_PER_PARTITION cells are cut further.
    """
    return max(LEAST_PARTITIONS, cells // (CELLS_PER_COEFFICIENT * max(width, 1)), -(-cells // CELLS_PER_PARTITION))


def train_hostname_model(
    df: DataFrame, url_col: str = "url", sizes: tuple[int, ...] = NGRAM_SIZES, min_df: int = MIN_DOCUMENTS,
    max_size: int | None = None, c: float = HOST_C, max_iter: int = 1000,
) -> HostnameModel:
    """Sub-linear TF-IDF over character n-grams with a balanced logistic regression.

    Training rows fold to (host, label, rows): equal rows enter the loss as one row
    with their number as weight, which leaves the optimum unchanged and shrinks the
    data to the distinct hosts.
    """
    hosts = df.select(ur.textual_host(F.col(url_col)).alias("host"), F.col("label").cast("int").alias("label"))
    folded = (
        hosts.where(F.col("host") != "").groupBy("host", "label").agg(F.count(F.lit(1)).alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    grams = numbered = None
    try:
        sizes_by_label = {r["label"]: r["n"] for r in folded.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        total = sum(sizes_by_label.values())
        documents = folded.groupBy("host").agg(F.sum("n").alias("n"))
        grams = host_grams(documents, "host", sizes, keys=["host", "n"]).persist(StorageLevel.MEMORY_AND_DISK)
        vocabulary = grams.groupBy("gram").agg(
            F.sum("n").alias("n_documents"), F.sum(F.col("n") * F.col("tf")).alias("n_terms"), F.count(F.lit(1)).alias("n_hosts")
        ).where(F.col("n_documents") >= min_df)
        if max_size is not None:
            vocabulary = vocabulary.orderBy(F.desc("n_terms"), "gram").limit(max_size)
        numbered = chunked_row_number(vocabulary.withColumn("_all", F.lit(1)), ["_all"], ["gram"], "index").select(
            "gram", (F.col("index") - 1).cast("int").alias("index"),
            (F.log((F.lit(1.0) + total) / (F.col("n_documents") + 1.0)) + 1.0).alias("idf"), "n_hosts",
        ).persist(StorageLevel.MEMORY_AND_DISK)
        width, cells = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_hosts"), F.lit(0))).first()
        weighed = grams.select("host", "gram", "tf").join(numbered.drop("n_hosts"), "gram").withColumn(
            "_x", (F.log(F.col("tf").cast("double")) + 1.0) * F.col("idf")
        )
        # a host has at most four n-grams per character, so the list per host is short
        rows = weighed.groupBy("host").agg(
            F.sort_array(F.collect_list(F.struct("index", "_x"))).alias("cells"), F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("norm")
        )
        weight = F.lit(1.0)
        for label, n in sizes_by_label.items():
            weight = F.when(F.col("label") == label, total / (len(sizes_by_label) * n)).otherwise(weight)
        to_vector = F.udf(lambda index, values: Vectors.sparse(width, index, values), VectorUDT())
        training = folded.join(rows, "host").select(
            to_vector(F.col("cells.index"), F.transform("cells._x", lambda x: x / F.col("norm"))).alias("vector"),
            F.col("label").cast("double").alias("label"), (F.col("n") * weight).alias("weight"),
        )
        fitted: LogisticRegressionModel = LogisticRegression(
            **_COMMON, weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * total), standardization=False
        ).fit(training.repartition(fit_partitions(cells, width)))
        spark = df.sparkSession
        coefficients = fitted.coefficients.toArray()
        table = spark.createDataFrame(
            [(i, float(v)) for i, v in enumerate(coefficients)], "index int, coefficient double"
        )
        weights = cut_lineage(numbered.join(table, "index").select("gram", "idf", "coefficient"))
        return HostnameModel(weights, float(fitted.intercept), sizes)
    finally:
        for table in (folded, grams, numbered):
            if table is not None:
                table.unpersist()


def behaviour_test(scored_cases: DataFrame) -> DataFrame:
    """Judge scored cases (category, url, expected, prediction, probability)."""
    return scored_cases.withColumn("correct", F.col("prediction") == F.col("expected"))
