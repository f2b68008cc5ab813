"""Label-preserving mutations and synthetic hard cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.functions import fixed_values as fv
from baitline.functions import urls as ur
from baitline.operators.dedup import staged_union
from baitline.operators.features import assert_feature_schema, url_features
from baitline.operators.splits import SEED, deterministic_shuffle

# What the mutations insert, and the names of the augmentation stages.
# The query marker's value is a free choice of the caller.
FRAGMENT = "section"
HOME = "home"
MARKER_KEY = "ref"
MARKER_VALUE = "internal"
SOURCES = [
    "original",
    "label_preserving_mutation",
    "hard_negative_legitimate_domain",
    "hard_positive_impersonation_domain",
]


def _form_decode(text: Column) -> Column:
    """Form decoding that leaves a stray percent sign alone."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"))


def _form_encode(text: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def marked_query(query: Column, value: str = MARKER_VALUE) -> Column:
    """Re-encoded query with a marker parameter added unless its key is there."""
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(
        items,
        lambda x: F.struct(
            _form_decode(F.substring_index(x, "=", 1)).alias("k"),
            _form_decode(F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2)).alias("v"),
        ),
    )
    marker = F.array(F.struct(F.lit(MARKER_KEY).alias("k"), F.lit(value).alias("v")))
    full = F.when(F.exists(pairs, lambda p: p["k"] == MARKER_KEY), pairs).otherwise(F.concat(pairs, marker))
    return F.array_join(
        F.transform(full, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&"
    )


def _rebuild(**changes: Column) -> Column:
    part = {c: changes.get(c, F.col(c)) for c in ("scheme", "host", "path", "query", "fragment")}
    host = part["host"]
    return F.concat(
        part["scheme"], F.lit("://"),
        F.coalesce(F.concat("userinfo", F.lit("@")), F.lit("")),
        F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host),
        F.coalesce(F.concat(F.lit(":"), F.col("port").cast("string")), F.lit("")),
        part["path"],
        F.when(part["query"] != "", F.concat(F.lit("?"), part["query"])).otherwise(F.lit("")),
        F.when(part["fragment"] != "", F.concat(F.lit("#"), part["fragment"])).otherwise(F.lit("")),
    )


def mutation_candidates(marker: str = MARKER_VALUE) -> dict[str, Column]:
    """Mutated URL per mutation name, from normalised parts; null where a mutation gives no valid URL."""
    scheme, host, path, query = (F.col(c) for c in ("scheme", "host", "path", "query"))
    www = host.startswith("www.")
    return {
        "toggle_scheme": _rebuild(scheme=F.when(scheme == "https", "http").otherwise("https")),
        # a bracketed address takes no prefix: the result would not be a URL, so there is no candidate
        "add_www": F.when(
            ~host.contains(":"), _rebuild(host=F.when((host == "") | www, host).otherwise(F.concat(F.lit("www."), host)))
        ),
        "remove_www": _rebuild(host=F.when(www, F.substr(host, F.lit(5))).otherwise(host)),
        "trailing_slash": _rebuild(
            path=F.when(path == "", "/").when(~path.endswith("/"), F.concat(path, F.lit("/")))
            .when(path == "/", path).otherwise(F.rtrim(path, F.lit("/")))
        ),
        "simple_query": _rebuild(query=marked_query(query, marker)),
        "fragment": _rebuild(fragment=F.lit(FRAGMENT)),
        "safe_path": _rebuild(
            path=F.when(path == "", f"/{HOME}").when(path.endswith("/"), F.concat(path, F.lit(HOME)))
            .otherwise(F.concat(path, F.lit(f"/{HOME}")))
        ),
        "remove_query": _rebuild(query=F.lit("")),
        "remove_fragment": _rebuild(fragment=F.lit("")),
    }


def mutate_urls(df: DataFrame, n: int, url_col: str = "url", marker: str = MARKER_VALUE) -> DataFrame:
    """Up to ``n`` different mutations per URL, one row each.

    Candidates are ranked by a hash of (URL, mutation) inside the row's own array, so
    picking them needs no shuffle. Adds ``original_url``, ``mutation`` and
    ``mutation_rank``; ``url_col`` holds the mutated URL.
    """
    base = ur.parsed(df, url_col).where(F.col("normalized_url").isNotNull())
    base = base.withColumn(
        "_all",
        F.array(*[
            F.struct(
                F.md5(F.concat(F.col("normalized_url"), F.lit(name))).alias("rank"),
                F.lit(name).alias("mutation"),
                expr.alias("url"),
            )
            for name, expr in mutation_candidates(marker).items()
        ]),
    )
    changed = F.filter(F.sort_array("_all"), lambda x: x["url"] != F.col("normalized_url"))
    base = base.withColumn("_changed", changed).withColumn("_urls", F.col("_changed.url"))
    unique = F.filter("_changed", lambda x, i: F.array_position(F.col("_urls"), x["url"]) == i + 1)
    kept = [c for c in df.columns if c not in (url_col, "original_url", "mutation", "mutation_rank", *ur.PART_COLUMNS)]
    return base.select(
        *kept, F.col("normalized_url").alias("original_url"), F.posexplode(F.slice(unique, 1, n)).alias("_pos", "_m")
    ).select(
        *kept, "original_url", F.col("_m.url").alias(url_col), F.col("_m.mutation").alias("mutation"),
        (F.col("_pos") + 1).alias("mutation_rank"),
    )


def _combine(
    domains: DataFrame, paths: list[str], shapes: list[str], label: int, source: str, domain_col: str, limit: int | None
) -> DataFrame:
    """Every domain with every path and URL shape, in that order."""
    def place(shape: str) -> Column:
        before, after = shape.split("{d}{p}")
        return F.concat(F.lit(before), F.col(domain_col), F.col("_path"), F.lit(after))

    ordered = "ord" in domains.columns
    rows = domains.select(
        domain_col, (F.col("ord") if ordered else F.col(domain_col)).alias("_d"),
        F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("_p", "_path"),
    ).select("_d", "_p", F.posexplode(F.array(*[place(s) for s in shapes])).alias("_s", "url"))
    if limit is not None:
        rows = rows.orderBy("_d", "_p", "_s").limit(limit)
    return ur.with_url_parts(rows).select(
        F.col("normalized_url").alias("url"), F.lit(label).alias("label"), F.lit(source).alias("augmentation_source")
    )


def literal_domains(spark: SparkSession, names: list[str]) -> DataFrame:
    """A domain table that keeps list order in ``ord``."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("ord", "domain"))


def hard_negatives(domains: DataFrame, paths: list[str] | None = None, domain_col: str = "domain", limit: int | None = None) -> DataFrame:
    """Legitimate URLs that look like phishing: trusted domains with sensitive paths.

    ``stock_hard_cases`` gives the stock list. ``domains`` is a curated table; without a
    ``limit`` every row is used. Each domain row is expanded in place by the two literal lists.
    """
    return _combine(domains, paths or fv.LEGITIMATE_PATHS, fv.HARD_NEGATIVE_SHAPES, 0, SOURCES[2], domain_col, limit)


def hard_positives(domains: DataFrame, paths: list[str] | None = None, domain_col: str = "domain", limit: int | None = None) -> DataFrame:
    """Impersonating URLs built from third-party hosts."""
    return _combine(domains, paths or fv.PHISHING_PATHS, fv.HARD_POSITIVE_SHAPES, 1, SOURCES[3], domain_col, limit)


def stock_hard_cases(spark: SparkSession) -> list[DataFrame]:
    """The two stock synthetic tables, whole."""
    return [
        hard_negatives(literal_domains(spark, fv.LEGITIMATE_DOMAINS)), hard_positives(literal_domains(spark, fv.PHISHING_HOSTS)),
    ]


def augmented_urls(df: DataFrame, n: int, synthetic: list[DataFrame] | None = None, order: str = "ord", marker: str = MARKER_VALUE) -> DataFrame:
    """Originals, then their mutations, then synthetic cases; earlier stages win repeats.

    Input: ``url``, ``label`` and an ``order`` column. Output: ``url``, ``label``,
    ``original_url``, ``augmentation_source``.
    """
    base = ur.with_url_parts(df).where(F.col("normalized_url").isNotNull())
    originals = base.select(
        F.col("normalized_url").alias("url"), F.col("label").cast("int").alias("label"),
        F.col("normalized_url").alias("original_url"), F.lit(SOURCES[0]).alias("augmentation_source"),
        F.struct(F.col(order).cast("long").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")).alias("ord"),
    )
    mutated = mutate_urls(base.select("url", "label", F.col(order).alias("_o"), *ur.PART_COLUMNS), n, marker=marker).select(
        "url", F.col("label").cast("int").alias("label"), "original_url",
        F.lit(SOURCES[1]).alias("augmentation_source"),
        F.struct(F.col("_o").cast("long").alias("a"), F.col("mutation_rank").alias("b"), F.lit("").alias("c")).alias("ord"),
    )
    stages = [originals, mutated]
    for table in synthetic or []:
        stages.append(
            table.select(
                "url", "label", F.col("url").alias("original_url"), "augmentation_source",
                F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.col("url").alias("c")).alias("ord"),
            )
        )
    return staged_union(stages).select("url", "label", "original_url", "augmentation_source")


def robust_split(
    df: DataFrame, n: int, synthetic: list[DataFrame] | None = None, order: str = "ord",
    check: bool = True, seed: int = SEED, marker: str = MARKER_VALUE,
) -> DataFrame:
    """Augmented, featurised, checked and shuffled version of one split."""
    rows = url_features(augmented_urls(df, n, synthetic, order, marker))
    out = rows.select(*fv.FEATURE_NAMES, "label", "url", "original_url", "augmentation_source")
    if check:
        assert_feature_schema(out)
    return deterministic_shuffle(out, "url", seed)


def behaviour_corpus(spark: SparkSession) -> DataFrame:
    """Curated URLs with label, source and features."""
    rows = [(u, 0, "adversarial_legitimate") for u in fv.CURATED_LEGITIMATE]
    rows += [(u, 1, "adversarial_phishing") for u in fv.CURATED_PHISHING]
    table = spark.createDataFrame(rows, "url string, label int, source string")
    return url_features(table).select(*fv.FEATURE_NAMES, "url", "label", "source")


def sensitivity_cases(spark: SparkSession, urls: list[str] | None = None) -> DataFrame:
    """Variants of one base URL; row 0 is the base."""
    names = urls or fv.SENSITIVITY_URLS
    return spark.createDataFrame(list(enumerate(names)), "variant int, url string")


def score_deltas(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Distance of every variant's probability from its base (variant 0 of the same ``base_url``, or of the one base there is)."""
    keyed = scored if "base_url" in scored.columns else scored.withColumn("base_url", F.lit(""))
    base = keyed.where(F.col("variant") == 0).select("base_url", F.col(probability).alias("base_probability"))
    joined = keyed.join(base, "base_url").select(*scored.columns, "base_probability")
    return joined.withColumn("delta", F.col(probability) - F.col("base_probability"))
