"""Scan history: row shape, recent scans, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns and types of the history table, in order.
HISTORY_COLUMNS = {
    "id": "bigint", "url": "string", "prediction": "string", "risk_score": "double",
    "risk_level": "string", "confidence": "double", "trusted_domain": "boolean",
    "url_ml_score": "double", "hostname_ml_score": "double", "model_score": "double",
    "rule_score": "double", "threat_score": "double", "vt_malicious": "int",
    "vt_suspicious": "int", "vt_harmless": "int", "vt_undetected": "int",
    "vt_total_engines": "int", "threat_intel_status": "string",
    "threat_intel_provider": "string", "scan_duration_ms": "double", "scanned_at": "timestamp",
}
# Verdicts counted by the statistics, as stored and as once counted.
VERDICTS = ["SAFE", "SUSPICIOUS", "PHISHING"]
CASED_VERDICTS = ["Safe", "Suspicious", "Phishing"]


def safe_double(name: str) -> Column:
    return F.expr(f"try_cast({name} AS DOUBLE)")


def safe_int(name: str) -> Column:
    return F.coalesce(F.expr(f"try_cast({name} AS INT)"), F.lit(0))


def history_rows(scans: DataFrame, id_col: str = "event_id", ts_col: str = "ts") -> DataFrame:
    """Assessed scans in history shape.

    Absent scores become null and absent engine counts 0; the hostname probability is
    stored in percent; the fusion score falls back to the model score; a cache hit is
    recorded with duration 0.
    """
    have = set(scans.columns)
    model = [safe_double(c) for c in ("fusion_score", "model_score") if c in have]
    duration = safe_double("scan_duration_ms") if "scan_duration_ms" in have else F.lit(None).cast("double")
    if "cache_hit" in have:
        duration = F.when(F.col("cache_hit"), F.lit(0.0)).otherwise(duration)
    values = {
        "id": F.col(id_col),
        "url": F.coalesce(F.col("normalized_url"), F.col("url")),
        "prediction": F.col("risk_level"),
        "risk_score": safe_double("risk_score"),
        "risk_level": F.col("risk_level"),
        "confidence": safe_double("confidence"),
        "trusted_domain": F.coalesce(F.col("trusted_domain"), F.lit(False)),
        "url_ml_score": safe_double("p_url") * 100.0,
        "hostname_ml_score": safe_double("p_host") * 100.0,
        "model_score": F.coalesce(*model),
        "rule_score": safe_double("rule_score"),
        "threat_score": safe_double("intel_score"),
        "vt_malicious": safe_int("malicious"),
        "vt_suspicious": safe_int("suspicious"),
        "vt_harmless": safe_int("harmless"),
        "vt_undetected": safe_int("undetected"),
        "vt_total_engines": safe_int("total_engines"),
        "threat_intel_status": F.col("intel_status"),
        "threat_intel_provider": F.col("intel_provider"),
        "scan_duration_ms": duration,
        "scanned_at": F.col(ts_col),
    }
    return scans.select(*[values[n].cast(t).alias(n) for n, t in HISTORY_COLUMNS.items()])


def recent_scans(history: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` newest scans, newest first."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return history.orderBy(F.desc("scanned_at"), F.desc("id")).limit(limit)


def scan_stats(history: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Total and verdict counts in one pass; an absent verdict counts 0."""
    verdict = F.col("prediction") if case_sensitive else F.upper("prediction")
    names = CASED_VERDICTS if case_sensitive else VERDICTS
    return history.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(verdict == n).alias(n.lower()) for n in names],
    )
