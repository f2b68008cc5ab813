"""Bounded samples of labelled texts, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, label, size) of each document that ``known`` (doc_id, label; one row per doc_id) and ``docs`` both have; size is its text's bytes."""
    sizes = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.sum(F.octet_length("text")).alias("size"),
    )
    return known.join(sizes, "doc_id")


def draw(docs: DataFrame, found: DataFrame, rows: dict[int, int], total_bytes: int) -> DataFrame:
    """(doc_id, label, text) of at most so many documents of each label and ``total_bytes`` in all.

    ``found`` is ``labelled``'s table. Documents come in the order of a hash of their ids,
    labels in turn; one that does not fit what is left of its label's share of the bytes
    is passed over.
    """
    chosen, left = [], total_bytes
    for turn, (label, most) in enumerate(rows.items()):
        share = left // (len(rows) - turn)
        listed = found.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "size").collect()
        for row in listed:
            if row["size"] <= share:
                share -= row["size"]
                left -= row["size"]
                chosen.append((row["doc_id"], label))
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
