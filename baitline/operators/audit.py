"""Corpus audits: labels, hosts, features, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baitline.functions import urls as ur
from baitline.functions.fixed_values import FEATURE_NAMES

# The shares of hosts reported by the concentration audit, in percent.
CONCENTRATION_PERCENTS = [0.1, 0.5, 1.0, 5.0]
TOP_DOMAINS = 20


def label_distribution(df: DataFrame, label: str = "label", by: str | None = None) -> DataFrame:
    """Rows and share (four decimals) per label, optionally within ``by``."""
    keys = [by, label] if by else [label]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    whole = Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(whole), 4))


def augmentation_distribution(df: DataFrame, source: str = "augmentation_source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))


def with_host(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Append ``domain`` (parsed host without edge dots); rows without one are dropped."""
    base = ur.parsed(df, url_col).withColumn("domain", ur.stripped_host(F.col("host")))
    return base.where(F.col("domain") != "")


def domain_labels(df: DataFrame, domain: str = "domain", label: str = "label") -> DataFrame:
    """Per host: lowest and highest label, rows, and the kind of host."""
    per = df.groupBy(domain).agg(
        F.min(label).alias("min_label"), F.max(label).alias("max_label"), F.count(F.lit(1)).alias("n_urls")
    )
    kind = (
        F.when((F.col("min_label") == 1) & (F.col("max_label") == 1), "phishing_only")
        .when((F.col("min_label") == 0) & (F.col("max_label") == 0), "legitimate_only")
        .otherwise("mixed")
    )
    return per.withColumn("kind", kind)


def domain_label_profile(df: DataFrame, domain: str = "domain", label: str = "label") -> DataFrame:
    """Number of hosts and URLs per kind of host."""
    return domain_labels(df, domain, label).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_domains"), F.sum("n_urls").alias("n_urls")
    )


def top_domains(df: DataFrame, domain: str = "domain", k: int = TOP_DOMAINS) -> DataFrame:
    """The ``k`` hosts with most URLs (ties by name)."""
    counts = df.groupBy(domain).agg(F.count(F.lit(1)).alias("n_urls"))
    return counts.orderBy(F.desc("n_urls"), domain).limit(k)


def domain_concentration(df: DataFrame, domain: str = "domain", percents: list[float] | None = None) -> DataFrame:
    """URLs held by the largest hosts: one row per percentage of hosts.

    The hosts are folded to a table of (URLs per host, number of such hosts), which
    stays small however many hosts there are, so the running totals are cheap and ties
    cannot change the sums.
    """
    percents = percents or CONCENTRATION_PERCENTS
    sizes = (
        df.groupBy(domain).agg(F.count(F.lit(1)).alias("size"))
        .groupBy("size").agg(F.count(F.lit(1)).alias("hosts"))
    )
    whole = Window.partitionBy(F.lit(1))
    largest_first = whole.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.select(
        "size", "hosts",
        F.coalesce(F.sum("hosts").over(largest_first), F.lit(0)).alias("before"),
        F.sum("hosts").over(whole).alias("n_domains"),
        F.sum(F.col("size") * F.col("hosts")).over(whole).alias("n_urls"),
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent")
    expanded = ranked.select("*", wanted).withColumn(
        "top_domains", F.greatest(F.lit(1), F.floor(F.col("n_domains") * F.col("percent") / 100).cast("long"))
    )
    taken = F.least(F.col("hosts"), F.greatest(F.col("top_domains") - F.col("before"), F.lit(0)))
    return expanded.groupBy("percent", "top_domains").agg(
        F.sum(taken * F.col("size")).alias("top_urls"),
        F.round(F.sum(taken * F.col("size")) * 100.0 / F.max("n_urls"), 2).alias("share_percent"),
    )


def mixed_domain_ratio(df: DataFrame, domain: str = "domain", label: str = "label") -> DataFrame:
    """Hosts carrying more than one label, and their share in percent (0 without hosts)."""
    per = df.groupBy(domain).agg((F.min(label) != F.max(label)).alias("mixed"))
    mixed, n = F.count_if("mixed"), F.count(F.lit(1))
    return per.agg(
        mixed.alias("mixed_domains"),
        n.alias("n_domains"),
        F.coalesce(F.round(mixed * 100.0 / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("mixed_percent"),
    )


def domains_per_split(df: DataFrame, domain: str = "domain", split: str = "split") -> DataFrame:
    return df.select(split, domain).distinct().groupBy(split).agg(F.count(F.lit(1)).alias("n_domains"))


def duplicate_audit(df: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """Rows, URLs and hosts repeated beyond their first occurrence.

    A URL has one host, so folding URLs first and hosts second gives all counts without
    a multi-column distinct.
    """
    per_url = df.groupBy(domain, url).agg(F.count(F.lit(1)).alias("n"))
    per_host = per_url.groupBy(domain).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("urls"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return per_host.agg(
        rows.alias("n_rows"),
        (rows - F.coalesce(F.sum("urls"), F.lit(0))).alias("repeated_urls"),
        (rows - F.count(F.lit(1))).alias("repeated_domains"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Occurrences per (feature, value); nulls are a value."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (feature, value)"))
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_median(long: DataFrame, key: str, value: str, buckets: int = 1024) -> DataFrame:
    """Exact median per key of a (key, value) table."""
    counts = long.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return median_of_counts(counts, key, value, buckets)


def median_of_counts(counts: DataFrame, key: str, value: str, buckets: int = 1024) -> DataFrame:
    """Exact median per key from distinct values with their counts ``n``.

    ``key`` is a feature name, so there are few keys. Values fall into equal-width
    buckets; only the one or two buckets around the middle rank are ordered.
    """
    span = counts.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("_total"))
    placed = counts.join(F.broadcast(span), key).withColumn(
        "_bucket",
        F.when(
            F.col("_hi") > F.col("_lo"),
            F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets),
        ).otherwise(F.lit(0)).cast("int"),
    )
    upto = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (
        placed.groupBy(key, "_bucket").agg(F.sum("n").alias("_n"), F.max("_total").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    )
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    last = F.col("_before") + F.col("_n")
    middle = per_bucket.where(
        (low.between(F.col("_before") + 1, last)) | (high.between(F.col("_before") + 1, last))
    ).select(key, "_bucket", "_before")
    inside = Window.partitionBy(key, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # at most two buckets per feature on the broadcast side
    ranked = placed.join(F.broadcast(middle), [key, "_bucket"]).withColumn(
        "_start", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_before")
    )
    covers = lambda rank: rank.between(F.col("_start") + 1, F.col("_start") + F.col("n"))
    return ranked.groupBy(key).agg(
        ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2).alias("median")
    )


def feature_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per feature: min, mean, median, max, distinct values, missing values, constant."""
    columns = columns or [c for c in FEATURE_NAMES if c in df.columns]
    counts = value_counts(df, columns)
    present = counts.where(F.col("value").isNotNull())
    stats = counts.groupBy("feature").agg(
        F.min("value").alias("min"),
        (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"),
        F.max("value").alias("max"),
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
    )
    # one row per feature on the broadcast side
    return stats.join(F.broadcast(median_of_counts(present, "feature", "value")), "feature", "left").select(
        "feature", "min", "mean", "median", "max", "n_distinct", "n_missing",
        (F.col("n_distinct") <= 1).alias("constant"),
    )
