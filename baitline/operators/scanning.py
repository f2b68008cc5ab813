"""The scan job: raw URLs in, assessed rows and rejected rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions.urls import PART_COLUMNS
from baitline.operators.cleaning import accepted, quarantine, validate_urls
from baitline.operators.features import url_features
from baitline.operators.intel import disabled_intel, enrich_threat_intel
from baitline.operators.risk import CURRENT, Policy, assess
from baitline.operators.rules import rule_score

# Takes validated rows, returns them with ``p_url`` and ``p_host`` (either may be null).
Scorer = Callable[[DataFrame], DataFrame]
# Takes scored rows, returns them with the intel columns.
Lookup = Callable[[DataFrame], DataFrame]


def no_models(df: DataFrame) -> DataFrame:
    """Scorer for a run without models: rules and threat reports decide."""
    nothing = F.lit(None).cast("double")
    return df.withColumns({"p_url": nothing, "p_host": nothing})


def logistic_scorer(url_weights: dict[str, float], host_weights: dict[str, float], url_bias: float = 0.0, host_bias: float = 0.0) -> Scorer:
    """Scorer from the coefficients of two logistic models over the URL features: one projection, no model object."""
    def chance(weights: dict[str, float], bias: float) -> Column:
        total = sum((F.col(f"used.{name}") * float(w) for name, w in weights.items()), F.lit(float(bias)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(df: DataFrame) -> DataFrame:
        names = sorted({*url_weights, *host_weights})
        rows = df.select(*PART_COLUMNS, F.struct(*df.columns).alias("kept"))
        featured = url_features(rows).select("kept", F.struct(*names).alias("used"))
        return featured.select("kept.*", chance(url_weights, url_bias).alias("p_url"), chance(host_weights, host_bias).alias("p_host"))

    return score


def scan(
    df: DataFrame, scorer: Scorer = no_models, reports: DataFrame | None = None,
    policy: Policy = CURRENT, signal_contract: str = "as_wired", lookup: Lookup | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Assess the valid rows of ``df`` (column ``url``); return them and the quarantine.

    One lineage without a shuffle up to the report join. Every step except the models
    is a projection. ``lookup`` takes the place of the join with ``reports``: it may see
    each scan's report as of its time, or leave rows as they are that carry the intel columns already.
    """
    checked = validate_urls(df)
    rows = scorer(rule_score(accepted(checked)))
    if lookup is not None:
        rows = lookup(rows)
    else:
        rows = disabled_intel(rows) if reports is None else enrich_threat_intel(rows, reports, url_col="normalized_url")
    return assess(rows, policy, signal_contract), quarantine(checked)


def scan_distinct(df: DataFrame, **options) -> DataFrame:
    """Assess each normalised URL once and hand the result to all its requests.

    The result table has one row per URL, so a URL that is asked for very often costs
    one assessment; its requests stay spread out because adaptive execution splits (or
    broadcasts around) a skewed join side.
    """
    checked = accepted(validate_urls(df))
    once = checked.select(F.col("normalized_url").alias("url")).distinct()
    results, _ = scan(once, **options)
    own = [c for c in results.columns if c not in df.columns and c != "normalized_url"]
    return checked.select(*df.columns, "normalized_url").join(
        results.select("normalized_url", *own), "normalized_url", "left"
    )
