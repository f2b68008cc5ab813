"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

Every row descends region, rack and shard. At each node the children draw
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the
smallest draw wins, so a child receives its share of the node's weight. A node's draw
depends on nothing but its own name and weight: changing one shard's weight moves rows
only between the subtrees that contain it and their siblings. A shard that is added as a
region of its own (``grown``) changes no other weight, so it only takes rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAW_BITS = 52
#: A shard's rows are numbered in so many pieces, of which each fits one task.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(regions: int, racks: int, shards: int) -> list[Leaf]:
    """An even tree: so many regions, racks in each and shards in each rack; all numbered through."""
    return [
        Leaf(r, r * racks + k, (r * racks + k) * shards + s)
        for r in range(regions) for k in range(racks) for s in range(shards)
    ]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The same tree with one more shard, in a region and rack of its own."""
    return [*leaves, Leaf(*(1 + max(getattr(x, level) for x in leaves) for level in ("region", "rack", "shard")), weight)]


def _draw(key: Column, level: str, child: Column) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{level}/"), child.cast("string")))
    whole = F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("double")
    return (whole + 0.5) / float(2**DRAW_BITS)


def _winner(key: Column, level: str, children: Column) -> Column:
    costs = F.transform(
        children, lambda c: F.struct((-F.log(_draw(key, level, c["node"])) / c["weight"]).alias("cost"), c["node"].alias("node")),
    )
    return F.array_min(costs)["node"]


def _children(leaves: list[Leaf], parent: str, child: str) -> Column:
    """Map from each parent to its children and their weights (sums of their leaves)."""
    weights: dict[int, dict[int, float]] = {}
    for x in leaves:
        if x.weight > 0:
            under = weights.setdefault(getattr(x, parent) if parent else 0, {})
            under[getattr(x, child)] = under.get(getattr(x, child), 0.0) + x.weight
    entries = []
    for p, nodes in weights.items():
        entries += [F.lit(p), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in nodes.items()])]
    return F.create_map(*entries)


def placed(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a string key. Leaves without weight get nothing."""
    region = _winner(key, "region", _children(leaves, "", "region")[F.lit(0)])
    rack = _winner(key, "rack", F.element_at(_children(leaves, "region", "rack"), region))
    return _winner(key, "shard", F.element_at(_children(leaves, "rack", "shard"), rack)).cast("int")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _bucket(key: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 7), 16, 10).cast("long") % buckets).cast("int")


def shard_documents(docs: DataFrame, leaves: list[Leaf], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Place every document and number the rows of each shard without gaps.

    The law is ``key``: doc_id and the tree decide. Slots are numbered in ``buckets``
    hashed pieces per shard with offsets from their counts, so no task holds a shard; the
    pieces must be set so that the largest shard divided by them fits a task. Rows with
    equal doc_id get neighbouring slots; a null doc_id counts as the key ``null``; a null
    text has size 1 and the checksum of no bytes. Other columns are left out.
    """
    key = _key(F.col("doc_id"))
    places = docs.select(
        "doc_id", "text", placed(key, leaves).alias("shard"), placed(key, grown(leaves)).alias("grown_shard"),
        _bucket(key, buckets).alias("bucket"),
    )
    counts = places.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = places.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        "shard", "grown_shard", "bucket",
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
    )
