"""Validation and cleaning of raw corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions import urls as ur
from baitline.functions.fixed_values import MAX_URL_LENGTH
from baitline.operators.audit import exact_median

# Accepted URL syntax and schemes, and the error codes of a rejection.
URL_SYNTAX = (
    r"^(?:https?://)?(?:(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}|(?:[0-9]{1,3}\.){3}[0-9]{1,3}|localhost)"
    r"(?:[:0-9]{0,6})?(?:[/?#].*)?$"
)
SCHEMES = ["http", "https"]
ERROR_CODES = ["empty", "too_long", "bad_syntax", "bad_scheme", "bad_port", "not_normalizable"]

# Names a URL or label column goes by, and what a URL-like value holds.
URL_COLUMN_NAMES = ["URL", "url", "Url", "URLText", "url_text", "Domain", "domain"]
LABEL_COLUMN_NAMES = ["label", "Label", "LABEL", "class", "Class"]
URL_LIKE = r"(?i)(https?://|www\.|\.[a-z]{2,})"


def validate_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Append URL parts and ``error_code`` (null when accepted)."""
    text = ur.strip(F.col(url_col))
    base = ur.with_url_parts(df, url_col).withColumn("_text", text)
    port_text = F.regexp_extract("_text", r"^(?:[hH][tT][tT][pP][sS]?://)?[^/?#:]+:([^/?#]*)", 1)
    code = (
        F.when(F.coalesce(F.length("_text"), F.lit(0)) == 0, "empty")
        .when(F.length("_text") > MAX_URL_LENGTH, "too_long")
        .when(~F.col("_text").rlike(URL_SYNTAX), "bad_syntax")
        .when((port_text != "") & ~port_text.rlike("^0*(?:[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$"), "bad_port")
        .when(F.col("normalized_url").isNull(), "not_normalizable")
        .when(~F.col("scheme").isin(SCHEMES), "bad_scheme")
    )
    return base.withColumn("error_code", code).drop("_text")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error_code").isNull()).drop("error_code")


def quarantine(validated: DataFrame, url_col: str = "url") -> DataFrame:
    return validated.where(F.col("error_code").isNotNull()).select(url_col, "error_code")


def drop_invalid_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Trim; drop null, empty and literal ``nan`` URLs."""
    out = df.withColumn(url_col, ur.strip(F.col(url_col).cast("string")))
    return out.where((F.col(url_col) != "") & (F.lower(url_col) != "nan"))


def coerce_label(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Numeric labels 0 and 1 as int; every other row is dropped."""
    value = F.expr(f"try_cast(`{label_col}` AS DOUBLE)")
    return df.where(value.isin(0.0, 1.0)).withColumn(label_col, value.cast("int"))


def number_or_null(name: str) -> Column:
    """Numeric value of a column; text that is no number, NaN and infinities give null."""
    value = F.expr(f"try_cast(`{name}` AS DOUBLE)")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, value)


def _tidy_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def clean_feature_table(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Clean a numeric training table and fill gaps with exact column medians.

    Drops all-null and repeated rows, tidies names, coerces to numbers, drops columns
    without any value. Two passes run here: one row of non-null counts (to fix the
    schema) and the medians, one number per column; both are bounded by the number of
    columns, never by the rows.
    """
    out = _tidy_names(df.na.drop("all").dropDuplicates())
    if label_col not in out.columns:
        raise ValueError(f"no column {label_col!r}")
    out = coerce_label(out, label_col)
    features = [c for c in out.columns if c != label_col]
    out = out.select(*[number_or_null(c).alias(c) for c in features], label_col)
    counts = out.agg(*[F.count(c).alias(c) for c in features]).first()
    kept = [c for c in features if counts[c]]
    out = out.select(*kept, label_col)
    gaps = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in kept]).first() if kept else {}
    holes = [c for c in kept if gaps[c]]
    if not holes:
        return out
    long = out.select(F.expr(unpivot(holes))).select("feature", "value")
    medians = {r["feature"]: r["median"] for r in exact_median(long, "feature", "value").collect()}
    return out.na.fill({c: medians[c] for c in holes})


def unpivot(columns: list[str]) -> str:
    """``stack`` expression giving (feature, value) rows."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return f"stack({len(columns)}, {pairs}) AS (feature, value)"


def constant_features(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row per feature: is it constant (nulls count as a value)?

    Constant means min equals max without a mix of nulls, so no distinct set is built.
    """
    features = [c for c in df.columns if c != label_col]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.count(c).alias("n")).alias(f"_{i}")
            for i, c in enumerate(features)
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            (
                (F.col(f"_{i}.n") == 0)
                | ((F.col(f"_{i}.n") == F.col("n")) & (F.col(f"_{i}.lo") == F.col(f"_{i}.hi")))
            ).alias("constant"),
        )
        for i, c in enumerate(features)
    ]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def drop_constant_features(df: DataFrame, label_col: str = "label") -> DataFrame:
    dead = [r["feature"] for r in constant_features(df, label_col).where("constant").collect()]
    return df.drop(*dead)


def detect_columns(df: DataFrame) -> tuple[str | None, str]:
    """Names of the URL and label columns.

    Known names win; otherwise the first column of whose values most are URL-like, over
    all rows, from one aggregation.
    """
    label = next((c for c in LABEL_COLUMN_NAMES if c in df.columns), None)
    if label is None:
        raise ValueError("label column not found")
    known = next((c for c in URL_COLUMN_NAMES if c in df.columns), None)
    if known:
        return known, label
    texts = {name: F.col(f"`{name}`").cast("string") for name in df.columns}
    shares = df.agg(*[F.avg(text.rlike(URL_LIKE).cast("int")).alias(f"_{i}") for i, text in enumerate(texts.values())]).first()
    found = (name for name, share in zip(texts, shares, strict=True) if share is not None and share > 0.5)
    return next(found, None), label


