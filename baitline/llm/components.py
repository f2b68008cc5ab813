"""Connected components of a table of links, by label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.llm.tables import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node it reaches.

    Each round passes the smallest label along all links and then follows labels of
    labels, so the rounds grow with the logarithm of a component's extent. Rounds are
    written to the shared folder and earlier ones deleted. Nodes with many links are
    reduced by map-side minima; nulls in either column are left out.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    state = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = edges.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        closer = state.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"),
        )
        beyond = state.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        after = written(
            closer.join(beyond, F.col("label") == F.col("at")).select("node", "old", F.least("label", "beyond").alias("label")), "labels",
        )
        discard(state)
        state = after.select("node", "label")
        state._written_at = after._written_at
        if after.filter("old <> label").isEmpty():
            discard(edges)
            return state.select("node", F.col("label").alias("component"))
