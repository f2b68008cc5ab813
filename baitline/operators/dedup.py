"""De-duplication and set operations with a defined survivor."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions import urls as ur


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key under ``order`` (which should be unique per key).

    An aggregate, not a window: copies collapse before the shuffle, so a key that holds
    a large share of all rows sends one row per input partition.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        first.alias("_row")
    ).select("_row.*")


def lowered(url: Column) -> Column:
    return F.lower(ur.strip(url.cast("string")))


def dedup_key(policy: str, url_col: str = "url") -> Column:
    """Duplicate key under one of the text policies."""
    url = F.col(url_col)
    if policy == "lower_trim":
        return lowered(url)
    if policy == "lower_trim_no_trailing_slash":
        return F.regexp_replace(lowered(url), "/$", "")
    if policy == "trim_add_http":
        text = ur.strip(url)
        has_scheme = text.startswith("http://") | text.startswith("https://")
        return F.when(has_scheme, text).when(F.length(text) > 0, F.concat(F.lit("http://"), text))
    raise ValueError(f"unknown policy: {policy}")


POLICIES = ["lower_trim", "lower_trim_no_trailing_slash", "trim_add_http", "normalized", "full_row"]


def dedup_urls(df: DataFrame, policy: str, order: list[str], url_col: str = "url") -> DataFrame:
    """Drop repeated URLs; the row that comes first under ``order`` survives.

    Rows without a usable key are dropped (``full_row`` has no key and keeps them).
    """
    if policy == "full_row":
        content = [c for c in df.columns if c not in order]
        return df.groupBy(*content).agg(*[F.min(c).alias(c) for c in order]).select(*df.columns)
    if policy == "normalized":
        keyed = ur.with_url_parts(df, url_col).withColumn("_key", F.col("normalized_url"))
    else:
        keyed = df.withColumn("_key", dedup_key(policy, url_col))
    keyed = keyed.select(*df.columns, "_key").where((F.col("_key") != ""))
    return keep_first(keyed, ["_key"], order).select(*df.columns)


def staged_union(stages: list[DataFrame], key: str = "url", order: str = "ord") -> DataFrame:
    """Union in which an earlier stage, then an earlier row, wins a key collision."""
    tagged = None
    for number, stage in enumerate(stages):
        one = stage.withColumn("stage", F.lit(number))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    return keep_first(tagged, [key], ["stage", order])


def union_for_refit(train: DataFrame, validation: DataFrame) -> DataFrame:
    """All rows of both splits, repeats kept."""
    return train.unionByName(validation)


def cross_split_overlap(
    df: DataFrame, key: str, split_col: str = "split", splits: tuple[str, ...] = ("train", "validation", "test")
) -> DataFrame:
    """Number of keys shared by each pair of splits; every count should be 0.

    One aggregation per key with a flag per split, then one row of counts. No pairwise
    joins.
    """
    per_key = df.groupBy(key).agg(
        *[F.max(F.when(F.col(split_col) == s, 1).otherwise(0)).alias(s) for s in splits]
    )
    pairs = list(combinations(splits, 2))
    counts = per_key.agg(
        *[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs]
    )
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"),
                               F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])
        ).alias("p")
    ).select("p.*")
