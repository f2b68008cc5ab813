"""From documents to tokens: drop toxic ones, keep one of each group of near copies, mix to target weights, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from baitline.llm import bpe, mixing, near_dedup, toxicity
from baitline.llm.queries import TOKENIZER
from baitline.llm.tables import table, written

#: Shares of tokens by domain. Every document stays at least once; those of a domain short of its share come more often.
WEIGHTS = {"good": 0.88, "poor": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs, near_dedup.Rule(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), WEIGHTS, floor=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
#: SQL cannot express the classifiers; a test follows the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
