"""The 40-column lexical feature table and its schema contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions import text as tx
from baitline.functions import urls as ur
from baitline.functions.characters import entropy, with_character_stats
from baitline.functions.fixed_values import (
    FEATURE_NAMES,
    FEATURE_TLDS,
    FEATURE_WORDS,
    NON_FEATURE_COLUMNS,
)

# Patterns behind three of the counts. A word counts when no ASCII
# letter or digit touches it; a hex run is 0x… or an isolated token of 8+ hex digits.
FEATURE_WORD_PATTERN = rf"(?<![a-z0-9]){tx.any_of(FEATURE_WORDS)}(?![a-z0-9])"
ENCODED_CHAR = r"%[0-9a-fA-F]{2}"
HEX_RUN = r"0x[0-9a-fA-F]+|(?<![a-zA-Z0-9])[0-9a-fA-F]{8,}(?![a-zA-Z0-9])"


def distinct_feature_words(url: Column) -> Column:
    """Number of different feature words present (matches cannot overlap)."""
    hits = F.regexp_extract_all(F.lower(url), F.lit(FEATURE_WORD_PATTERN), F.lit(0))
    return F.size(F.array_distinct(hits))


def feature_tld(domain: Column) -> Column:
    return F.coalesce(ur.last_label(domain).isin(FEATURE_TLDS), F.lit(False))


def feature_subdomains(host: Column, domain: Column) -> Column:
    """Labels in front of the registered domain, a leading ``www`` not counted."""
    prefix = F.rtrim(F.substr(host, F.lit(1), F.length(host) - F.length(domain)), F.lit("."))
    labels = tx.occurrences(prefix, ".") + 1
    is_www = (prefix == "www") | prefix.startswith("www.")
    return F.when(F.length(prefix) == 0, 0).otherwise(labels - tx.flag(is_www))


def url_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Append the 40 feature columns; a pure projection, no shuffle.

    Rows whose URL cannot be normalised get nulls.
    """
    base = ur.parsed(df, url_col)
    u, host, path, query = (F.col(c) for c in ("normalized_url", "host", "path", "query"))
    base = base.withColumns({
        "_domain": ur.registered_domain(host),
        "_encoded": F.when(u.contains("%"), F.regexp_count(u, F.lit(ENCODED_CHAR))).otherwise(0),
        "_words": distinct_feature_words(u),
    })
    base = base.withColumn("_subdomains", feature_subdomains(host, F.col("_domain")))
    base = with_character_stats(base, "normalized_url", "_chars").withColumns({
        "_host_bits": entropy(host), "_path_bits": entropy(path),
    })
    size = F.length(u)
    exprs = {
        "url_length": size,
        "hostname_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "fragment_length": F.length("fragment"),
        "letter_count": F.col("_chars.letters"),
        "digit_count": F.col("_chars.digits"),
        "special_char_count": F.col("_chars.specials"),
        "digit_ratio": tx.ratio(F.col("_chars.digits"), size),
        "letter_ratio": tx.ratio(F.col("_chars.letters"), size),
        "special_char_ratio": tx.ratio(F.col("_chars.specials"), size),
        **{
            f"{name}_count": tx.occurrences(u, symbol)
            for name, symbol in {
                "dot": ".", "hyphen": "-", "slash": "/", "underscore": "_", "at": "@",
                "equals": "=", "question_mark": "?", "ampersand": "&", "percent": "%", "hash": "#",
            }.items()
        },
        "subdomain_count": F.col("_subdomains"),
        "is_ip_address": tx.flag(host.rlike(ur.IPV4_LOOSE)),
        "has_punycode": tx.flag(host.contains("xn--")),
        "has_credentials": tx.flag(F.col("userinfo").isNotNull()),
        "has_https": tx.flag(F.col("scheme") == "https"),
        "encoded_char_count": F.col("_encoded"),
        "hex_sequence_count": F.regexp_count(u, F.lit(HEX_RUN)),
        "has_url_encoding": tx.flag(u.contains("%") & u.rlike(ENCODED_CHAR)),
        "path_depth": tx.non_empty_parts(path, "/"),
        "query_parameter_count": tx.non_empty_parts(query, "&"),
        "suspicious_word_count": F.col("_words"),
        "has_suspicious_word": tx.flag(F.col("_words") > 0),
        "has_suspicious_tld": tx.flag(feature_tld(F.col("_domain"))),
        "url_entropy": F.col("_chars.bits"),
        "hostname_entropy": F.col("_host_bits"),
        "path_entropy": F.col("_path_bits"),
        "subdomain_ratio": F.when(
            F.length(host) > 0,
            F.col("_subdomains").cast("double") / (tx.occurrences(host, ".") + 1),
        ).otherwise(F.lit(0.0)),
        "path_to_url_ratio": tx.ratio(F.length(path), size),
        "query_to_url_ratio": tx.ratio(F.length(query), size),
    }
    assert list(exprs) == FEATURE_NAMES
    keep = [c for c in base.columns if not c.startswith("_") and c not in exprs]
    return base.select(*keep, *[F.when(u.isNotNull(), e).alias(n) for n, e in exprs.items()])


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Model inputs of a training table: everything but labels and identifiers."""
    skip = set(NON_FEATURE_COLUMNS) | set(exclude or [])
    return [c for c in df.columns if c not in skip]


def select_features(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    return df.select(*feature_columns(df, exclude))


def feature_schema_report(df: DataFrame) -> DataFrame:
    """One row telling whether ``df`` honours the feature contract.

    Checks names and order (from the schema), missing values and repeated URLs (one
    pass over the data; the URL check groups by URL so repeats combine map-side).
    """
    present = [c for c in FEATURE_NAMES if c in df.columns]
    in_order = [c for c in df.columns if c in set(FEATURE_NAMES)] == FEATURE_NAMES
    missing = [c for c in FEATURE_NAMES if c not in df.columns]
    bad_row = F.lit(False)
    for c in present:
        value = F.col(c).cast("double")
        bad_row = bad_row | value.isNull() | F.isnan(value)
    per_url = df.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tx.flag(bad_row)).alias("bad")
    )
    return per_url.agg(
        F.lit(in_order).alias("names_in_order"),
        F.lit(len(missing)).alias("missing_columns"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_urls"),
    )


def assert_feature_schema(df: DataFrame, same_as: DataFrame | None = None) -> DataFrame:
    """Raise on a broken feature table, otherwise hand it back unchanged."""
    names = [c for c in df.columns if c in set(FEATURE_NAMES)]
    if names != FEATURE_NAMES:
        missing = [c for c in FEATURE_NAMES if c not in df.columns]
        raise ValueError(f"feature columns differ from the contract; missing: {missing}")
    if same_as is not None and [c for c in same_as.columns if c in set(FEATURE_NAMES)] != names:
        raise ValueError("feature order differs between splits")
    row = feature_schema_report(df).first()
    if row["invalid_rows"] or row["repeated_urls"]:
        raise ValueError(
            f"{row['invalid_rows']} rows with missing values, {row['repeated_urls']} repeated URLs"
        )
    return df
