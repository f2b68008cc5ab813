"""Shared inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.functions.urls import with_url_parts
from baitline.operators.cleaning import SCHEMES
from baitline.operators.features import url_features
from baitline.operators.intel import enrich_threat_intel, settled_reports, threat_report_from_verdicts
from baitline.operators.risk import assess
from baitline.operators.rules import rule_score
from baitline.sources import tables as t

# Probe variants that are phishing-like, used as a learnable label.
PHISHING_VARIANTS = [1, 2, 3, 5, 7, 8, 14, 15]


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def normal_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Probes with parts, only those that can be normalised."""
    return with_url_parts(t.probes(spark, folder)).where("normalized_url IS NOT NULL")


def scored_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Normal probes with rule score and pseudo model probabilities (some missing)."""
    base = rule_score(normal_probes(spark, folder))
    return base.withColumns({
        "p_url": F.when(F.col("variant") % 7 != 6, t.pseudo_probability(F.col("normalized_url"), "u")),
        "p_host": F.when(F.col("variant") % 5 != 4, t.pseudo_probability(F.col("normalized_url"), "h")),
    })


# Probe variants that are looked up by their own URL, which has no report, and one scanned without a lookup.
OWN_LOOKUP, NO_LOOKUP = [3, 8], 15


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return settled_reports(threat_report_from_verdicts(t.verdicts(spark, folder)), t.report_states(spark, folder))


def with_reports(spark: SparkSession, folder: str, probes: DataFrame, own: str) -> DataFrame:
    """Probes with their reports: of their page, of their ``own`` URL, or not looked up."""
    looked = probes.withColumn("_looked", F.when(F.col("variant").isin(OWN_LOOKUP), F.col(own)).otherwise(F.col("page_url")))
    return enrich_threat_intel(looked, reports(spark, folder), url_col="_looked", wanted=F.col("variant") != NO_LOOKUP).drop("_looked")


def scan_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Everything the fusion step needs, one row per probe."""
    return with_reports(spark, folder, scored_probes(spark, folder), "normalized_url")


def assessed_probes(spark: SparkSession, folder: str) -> DataFrame:
    return assess(scan_inputs(spark, folder))


# Coefficients of the two logistic models that the whole scan runs with.
URL_WEIGHTS = {"url_length": 0.01, "dot_count": 0.3, "digit_ratio": 4.0, "suspicious_word_count": 0.9, "has_suspicious_tld": 1.5, "has_https": -0.4}
HOST_WEIGHTS = {"hostname_length": 0.02, "hostname_entropy": 0.5, "subdomain_count": 0.2, "is_ip_address": 2.0}
URL_BIAS, HOST_BIAS = -2.5, -2.0


def scan_asks(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, user_id, ts, page_url, url: every third event asks for a probe of its page, each in turn."""
    n = t.page_count(spark, folder)
    asks = t.page_events(spark, folder).where("event_id % 3 = 0").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "page_id",
        (F.floor(F.col("event_id") / n) % t.N_PROBES).cast("int").alias("variant"),
    )
    return asks.join(t.probes(spark, folder), ["page_id", "variant"])


def scan_events(spark: SparkSession, folder: str) -> DataFrame:
    n = t.page_count(spark, folder)
    return t.read(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("scan_duration_ms"),
        (F.col("event_id") % n).alias("page_id"), (F.col("event_id") % 3 == 0).alias("cache_hit"),
        (F.floor(F.col("event_id") / n) % t.N_PROBES).cast("int").alias("variant"),
    )


def scan_log(spark: SparkSession, folder: str) -> DataFrame:
    """One scan per event that asks for a probe that can be normalised, all probes of a page in turn; every third is a cache hit."""
    return scan_events(spark, folder).join(assessed_probes(spark, folder), ["page_id", "variant"])


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """url, label, category, features of the normal probes of an accepted scheme."""
    rows = normal_probes(spark, folder).where(F.col("scheme").isin(SCHEMES)).select(
        "page_id", "variant", F.col("normalized_url").alias("url"),
        F.col("variant").isin(PHISHING_VARIANTS).cast("int").alias("label"),
    )
    return url_features(rows)


