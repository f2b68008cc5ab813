"""Lookups of the scanning job, expressed as joins and in-row tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.functions import urls as ur
from baitline.functions.fixed_values import BRAND_DOMAINS, JOB_TTL_SECONDS, RULE_TLDS
from baitline.operators.features import distinct_feature_words, feature_tld
from baitline.operators.risk import trusted_host
from baitline.operators.rules import brand_matches, rule_word_count
from baitline.operators.windows import job_seen_at

# Fixed value: what a well-formed job id looks like.
SCAN_ID_PATTERN = r"^[A-Za-z0-9_-]{1,128}$"


def flag_trusted(df: DataFrame, trusted: DataFrame | None = None, domain_col: str = "domain", url_col: str = "url") -> DataFrame:
    """Append ``trusted_domain``: the host is a trusted domain or below one.

    Without a table the built-in list is tested in the row. With a table the suffix
    test becomes an equi-join: distinct hosts are expanded to their label-aligned
    suffixes and semi-joined, so repeated hosts cost one lookup and no host is compared
    with the whole list.
    """
    base = ur.parsed(df, url_col)
    if trusted is None:
        return base.withColumn("trusted_domain", trusted_host(F.col("host")))
    names = trusted.select(F.lower(F.col(domain_col)).alias("_suffix")).distinct()
    known = (
        base.select("host").where(F.col("host").isNotNull()).distinct()
        .select("host", F.explode(ur.host_suffixes(F.col("host"))).alias("_suffix"))
        .join(names, "_suffix", "left_semi")
        .select("host").distinct()
        .withColumn("_known", F.lit(True))
    )
    return (
        base.join(known, "host", "left")
        .withColumn("trusted_domain", F.coalesce("_known", F.lit(False)))
        .select(*base.columns, "trusted_domain")
    )


def brand_impersonation(df: DataFrame, brands: dict[str, list[str]] | None = None, url_col: str = "url") -> DataFrame:
    """Append the sorted ``brand_matches`` array and ``brand_impersonation``."""
    base = ur.parsed(df, url_col)
    host = ur.stripped_host(F.col("host"))
    out = base.withColumn("brand_matches", brand_matches(host, ur.registered_domain(host), brands or BRAND_DOMAINS))
    return out.withColumn("brand_impersonation", F.size("brand_matches") > 0)


def suspicious_tld(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Append both TLD flags: feature list on the registered domain, rule list on the host."""
    base = ur.parsed(df, url_col)
    host = F.col("host")
    return base.withColumns({
        "feature_tld": feature_tld(ur.registered_domain(host)),
        "rule_tld": F.coalesce(ur.last_label(host).isin(RULE_TLDS), F.lit(False)),
    })


def suspicious_words(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Append both word counts: distinct feature words, all rule-word occurrences."""
    base = ur.parsed(df, url_col)
    return base.withColumns({
        "feature_words": distinct_feature_words(F.col("normalized_url")),
        "rule_words": rule_word_count(F.col("normalized_url")),
    })


def combine_model_scores(
    urls: DataFrame, url_scores: DataFrame, host_scores: DataFrame, key: str = "url", probability: str = "probability"
) -> DataFrame:
    """Align two optional scores per URL.

    Both score tables are folded to one row per key in a single aggregation (highest
    probability on a repeat), so the URL table is shuffled for one join, not two.
    """
    tagged = url_scores.select(key, F.col(probability).alias("p_url"), F.lit(None).cast("double").alias("p_host"))
    tagged = tagged.unionByName(
        host_scores.select(key, F.lit(None).cast("double").alias("p_url"), F.col(probability).alias("p_host"))
    )
    scores = tagged.groupBy(key).agg(F.max("p_url").alias("p_url"), F.max("p_host").alias("p_host"))
    return urls.join(scores, key, "left")


def score_cases(cases: DataFrame, predictions: DataFrame, key: str = "url") -> DataFrame:
    """Expected against predicted, one row per predicted case.

    ``key`` names a case. Predictions that repeat a key count once, with the highest probability.
    """
    guess = F.struct("probability", "prediction")
    once = predictions.groupBy(key).agg(F.max(guess).alias("_guess")).select(key, "_guess.prediction", "_guess.probability")
    joined = cases.join(once, key, "inner")
    return joined.withColumn("correct", F.col("prediction") == F.col("expected"))


def job_status(ids: DataFrame, jobs: DataFrame, id_col: str = "scan_id") -> DataFrame:
    """Answer status polls: ``invalid``, ``not_found`` or the job's own status."""
    latest = jobs.select(F.col(id_col), F.col("status").alias("_status"), "url", "updated_at")
    joined = ids.join(latest, id_col, "left")
    answer = (
        F.when(~F.coalesce(F.col(id_col).rlike(SCAN_ID_PATTERN), F.lit(False)), F.lit("invalid"))
        .when(F.col("_status").isNull(), F.lit("not_found"))
        .otherwise(F.col("_status"))
    )
    return joined.withColumn("status", answer).drop("_status")


def job_status_at(
    polls: DataFrame, changes: DataFrame, id_col: str = "scan_id", polled_at: str = "polled_at", change_id: str = "event_id",
    seconds: float = JOB_TTL_SECONDS,
) -> DataFrame:
    """Answer polls at their own times: ``invalid``, ``not_found``, or the job's status with ``seen_us`` and ``url`` then.

    An as-of join: what counts is the last change before the poll that the job still had,
    and only while its lifetime lasts. Several changes with one ``change_id`` give an
    answer each.
    """
    seen = job_seen_at(polls, changes, id_col, polled_at, id_col=change_id, seconds=seconds)
    states = changes.select(F.col(change_id).cast("long").alias("_change"), F.col("status").alias("_status"), "url")
    joined = seen.join(states, F.col("seen_id") == F.col("_change"), "left")
    answer = (
        F.when(~F.coalesce(F.col(id_col).rlike(SCAN_ID_PATTERN), F.lit(False)), F.lit("invalid"))
        .when(F.col("_status").isNull(), F.lit("not_found"))
        .otherwise(F.col("_status"))
    )
    return joined.withColumn("status", answer).drop("_status", "_change", "seen_id")


def split_membership_overlap(left: DataFrame, right: DataFrame, key: str = "domain") -> DataFrame:
    """Keys present in both tables, once each (both sides are made unique first)."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
