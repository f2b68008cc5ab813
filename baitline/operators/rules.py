"""Explainable rule signals and the deterministic rule score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions import text as tx
from baitline.functions import urls as ur
from baitline.functions.characters import entropy
from baitline.functions.emit import emit_once
from baitline.functions.fixed_values import (
    AUTH_PATH_PARTS,
    BRAND_DOMAINS,
    RULE_TLDS,
    RULE_WORDS,
)

# A rule word is a whole run of word characters; an authentication path
# contains one of the parts in any letter case.
WORD_CHAR = r"[\p{L}\p{N}_]"
RULE_WORD_PATTERN = rf"(?<!{WORD_CHAR}){tx.any_of(RULE_WORDS)}(?!{WORD_CHAR})"
AUTH_PATH_PATTERN = "(?i)" + tx.any_of(AUTH_PATH_PARTS)

# Thresholds of the boolean signals.
MANY_SUBDOMAINS = 4
DEEP_PATH = 6
MANY_PARAMETERS = 8
MANY_PERCENTS = 3
HIGH_ENTROPY = 4.0
LONG_URL = 200
LONG_HOST = 80

# Points and message per rule, in reporting order. The condition names
# are signals, or conjunctions of signals and word-count bounds.
RULES = [
    ("has_credentials", 25, "Credentials embedded in URL"),
    ("has_at_symbol", 20, "@ symbol can obscure the destination"),
    ("is_ip_address", 15, "IP address used instead of a domain"),
    ("excessive_percent_encoding", 15, "Excessive URL encoding"),
    ("excessive_subdomains", 15, "Excessive number of subdomains"),
    ("suspicious_tld", 10, "Suspicious top-level domain"),
    ("brand_impersonation", 20, "Possible brand impersonation"),
    ("words>=3", 10, "Multiple security-sensitive words found in URL"),
    ("words 1-2", 4, "Security-sensitive words found in URL"),
    ("suspicious_path_structure", 5, "Suspicious authentication/account path"),
    ("deep_path", 5, "Unusually deep URL path"),
    ("many_query_parameters", 5, "Large number of query parameters"),
    ("high_hostname_entropy", 10, "High hostname randomness"),
    ("high_path_entropy", 5, "High path randomness"),
    ("very_long_url", 5, "Unusually long URL"),
    ("very_long_hostname", 5, "Unusually long hostname"),
    ("insecure_http", 3, "Connection does not use HTTPS"),
    ("brand_impersonation & words>=2", 20, "Brand impersonation combined with suspicious language"),
    ("is_ip_address & suspicious_path_structure", 15, "IP address combined with authentication path"),
    ("has_credentials & suspicious_path_structure", 15, "Credentials combined with authentication path"),
    ("suspicious_tld & suspicious_path_structure", 10, "Suspicious TLD combined with authentication path"),
    ("suspicious_tld & brand_impersonation", 15, "Suspicious TLD combined with possible brand impersonation"),
]
# Lowest score of each rule level.
RULE_LEVELS = [(60, "HIGH"), (30, "MEDIUM"), (10, "LOW")]
LOWEST_RULE_LEVEL = "MINIMAL"
MAX_RULE_SCORE = 100


def rule_word_count(url: Column) -> Column:
    """Occurrences of rule words, all words together."""
    return F.regexp_count(F.lower(url), F.lit(RULE_WORD_PATTERN))


def brand_matches(host: Column, domain: Column, brands: dict[str, list[str]] | None = None) -> Column:
    """Sorted array of brands named in the host although the domain is not theirs.

    The brand list is a handful of literals, so each row tests it in place: no join
    and no row expansion.
    """
    found = [
        F.when(host.contains(brand) & ~domain.isin(owned), F.lit(brand))
        for brand, owned in sorted((brands or BRAND_DOMAINS).items())
    ]
    return F.array_compact(F.array(*found))


def rule_subdomains(host: Column) -> Column:
    """Labels beyond two, 0 for an address."""
    dots = tx.occurrences(host, ".")
    return F.when(ur.is_ip(host), 0).otherwise(F.greatest(dots - 1, F.lit(0)))


def rule_signals(df: DataFrame, url_col: str = "url", brands: dict[str, list[str]] | None = None) -> DataFrame:
    """Append the ``signals`` struct; a pure projection."""
    base = ur.parsed(df, url_col)
    u, host, path, query = (F.col(c) for c in ("normalized_url", "host", "path", "query"))
    clean_host = ur.stripped_host(host)
    base = base.withColumns({
        "_brands": brand_matches(clean_host, ur.registered_domain(clean_host), brands),
        "_word_hits": rule_word_count(u),
        "_labels": rule_subdomains(host),
        "_depth": tx.non_empty_parts(path, "/"),
        "_params": F.when(F.length(query) > 0, tx.occurrences(query, "&") + 1).otherwise(0),
    })
    base = base.withColumns({"_host_bits": entropy(host), "_path_bits": entropy(path)})
    named = {
        "is_https": F.col("scheme") == "https",
        "is_ip_address": ur.is_ip(host),
        "has_credentials": F.col("userinfo").isNotNull(),
        "url_length": F.length(u),
        "hostname_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "subdomain_count": F.col("_labels"),
        "excessive_subdomains": F.col("_labels") >= MANY_SUBDOMAINS,
        "suspicious_tld": F.coalesce(ur.last_label(host).isin(RULE_TLDS), F.lit(False)),
        "suspicious_word_count": F.col("_word_hits"),
        "has_suspicious_words": F.col("_word_hits") > 0,
        "brand_impersonation": F.size("_brands") > 0,
        "brand_matches": F.col("_brands"),
        "has_at_symbol": u.contains("@"),
        "has_percent_encoding": u.contains("%"),
        "has_hex_encoding": u.contains("%") & u.rlike(r"%[0-9a-fA-F]{2}"),
        "excessive_percent_encoding": tx.occurrences(u, "%") >= MANY_PERCENTS,
        "path_depth": F.col("_depth"),
        "deep_path": F.col("_depth") >= DEEP_PATH,
        "suspicious_path_structure": path.rlike(AUTH_PATH_PATTERN),
        "query_parameter_count": F.col("_params"),
        "many_query_parameters": F.col("_params") >= MANY_PARAMETERS,
        "hostname_entropy": F.col("_host_bits"),
        "path_entropy": F.col("_path_bits"),
        "high_hostname_entropy": F.col("_host_bits") >= HIGH_ENTROPY,
        "high_path_entropy": F.col("_path_bits") >= HIGH_ENTROPY,
        "very_long_url": F.length(u) >= LONG_URL,
        "very_long_hostname": F.length(host) >= LONG_HOST,
        "insecure_http": F.col("scheme") == "http",
    }
    signals = F.struct(*[e.alias(n) for n, e in named.items()])
    keep = [c for c in base.columns if not c.startswith("_")]
    return emit_once(base, keep, {"signals": F.when(u.isNotNull(), signals)})


def _condition(text: str, signals: str) -> Column:
    words = F.col(f"{signals}.suspicious_word_count")
    bounds = {"words>=3": words >= 3, "words>=2": words >= 2, "words 1-2": words.between(1, 2)}
    out = None
    for name in text.split(" & "):
        one = bounds[name] if name in bounds else F.col(f"{signals}.{name}")
        out = one if out is None else out & one
    return out


def rule_score(df: DataFrame, url_col: str = "url", signals: str = "signals") -> DataFrame:
    """Append ``rule_score`` (0-100), ``rule_level`` and the ordered ``rule_reasons``."""
    base = df if signals in df.columns else rule_signals(df, url_col)
    base = base.withColumn("_hits", F.array(*[_condition(c, signals) for c, _, _ in RULES]))
    points = sum(
        (F.when(F.col("_hits")[i], p).otherwise(0) for i, (_, p, _) in enumerate(RULES)), F.lit(0)
    )
    reasons = F.array_compact(
        F.array(*[F.when(F.col("_hits")[i], F.lit(m)) for i, (_, _, m) in enumerate(RULES)])
    )
    known = F.col(signals).isNotNull()
    base = base.withColumns({
        "rule_score": F.when(known, F.least(points, F.lit(MAX_RULE_SCORE))),
        "rule_reasons": F.when(known, reasons),
    })
    level = F.when(F.col("rule_score") >= RULE_LEVELS[0][0], RULE_LEVELS[0][1])
    for bound, name in RULE_LEVELS[1:]:
        level = level.when(F.col("rule_score") >= bound, name)
    level = level.when(F.col("rule_score").isNotNull(), LOWEST_RULE_LEVEL)
    keep = [c for c in df.columns if c not in ("rule_score", "rule_reasons", "rule_level", "signals")]
    keep += [c for c in ur.PART_COLUMNS if c not in keep and c in base.columns]
    return emit_once(
        base.withColumn("_level", level), [*keep, signals],
        {"rule_score": F.col("rule_score"), "rule_level": F.col("_level"), "rule_reasons": F.col("rule_reasons")},
    )
