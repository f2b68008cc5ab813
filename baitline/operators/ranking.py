"""Exact ranks and running totals that never put one group into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baitline.functions.hashing import leading_bits
from baitline.session import cut_lineage


def running_totals(df: DataFrame, order: str, totals: list[str], buckets: int = 64) -> DataFrame:
    """Append ``before_<t>``: the sum of ``t`` over all rows with a smaller ``order``.

    ``order`` is numeric and unique per row. Rows are cut into value ranges of about
    equal size (approximate quantiles only balance the work, they do not change the
    result); a window runs inside each range, and the handful of range totals supplies
    the offsets.
    """
    cuts = df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    inner = sorted(set(cuts))
    bounds = [float("-inf"), *inner, float("inf")]
    if len(bounds) > 2:
        ranged = Bucketizer(splits=bounds, inputCol=order, outputCol="_range").transform(df)
    else:
        ranged = df.withColumn("_range", F.lit(0.0))
    per_range = ranged.groupBy("_range").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_sum_{t}").over(earlier), F.lit(0)).alias(f"_off_{t}") for t in totals]
    )
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # at most ``buckets`` rows on the broadcast side
    joined = ranged.join(F.broadcast(offsets), "_range")
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"_off_{t}")).alias(f"before_{t}") for t in totals],
    )


def chunked_row_number(df: DataFrame, group: list[str], order: list[str], name: str, chunks: int | None = None) -> DataFrame:
    """Row number per group for groups of any size.

    Rows are range-partitioned on (group, order), so a large group spreads over many
    chunks; the chunk number is made durable by a checkpoint, each chunk is numbered on
    its own, and the counts of earlier chunks are added.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(chunks, *keys) if chunks else df.repartitionByRange(*keys)
    ranged = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (
        ranged.join(offsets, [*group, "_chunk"])
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_chunk", "_offset")
    )


def hash_cuts(df: DataFrame, digest: str, group: str, sizes: dict[str, object], bits: int = 16) -> DataFrame:
    """Digests that cut each group after exactly ``k`` rows in digest order.

    ``sizes`` maps an output column to an expression of ``_total`` (rows of the group)
    giving ``k``. Only a histogram over digest prefixes covers all rows; exact ranks
    are taken inside the one prefix that contains a cut. The result has one row per
    group. Digests should be unique within a group.
    """
    prefixed = df.select(group, digest, leading_bits(F.col(digest), bits).alias("_prefix"))
    per = prefixed.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumns({
        "_upto": F.sum("_n").over(upto),
        "_total": F.sum("_n").over(Window.partitionBy(group)),
    })
    wanted = F.array(*[F.struct(F.lit(n).alias("cut"), k.cast("long").alias("k")) for n, k in sizes.items()])
    located = (
        per.select(group, "_prefix", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.explode(wanted).alias("w"))
        .where((F.col("w.k") > F.col("_before")) & (F.col("w.k") <= F.col("_upto")))
        .select(group, "_prefix", "_before", "w.cut", "w.k")
    )
    inside = Window.partitionBy(group, "_prefix", "cut").orderBy(digest)
    # one row per cut and group on the broadcast side; groups are labels or a constant
    ranked = prefixed.join(F.broadcast(located), [group, "_prefix"]).withColumn(
        "_rank", F.row_number().over(inside) + F.col("_before")
    )
    return (
        ranked.where(F.col("_rank") == F.col("k"))
        .groupBy(group)
        .agg(*[F.max(F.when(F.col("cut") == n, F.col(digest))).alias(n) for n in sizes])
    )
