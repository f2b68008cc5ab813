"""Reproducible train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions.hashing import HASH_SPACE, leading_bits, seeded_md5
from baitline.operators.ranking import hash_cuts

# Share held out from training, share of that used for testing, seed.
HELD_OUT = 0.30
TEST_OF_HELD_OUT = 0.50
SEED = 42


def _sizes(held_out: float, test_share: float) -> dict[str, Column]:
    """Rows up to the end of training, and up to the end of validation."""
    total = F.col("_total")
    held = F.ceil(total * held_out)
    test = F.ceil(held * test_share)
    return {"_train_end": total - held, "_validation_end": total - test}


def _assign(digest: str) -> Column:
    return (
        F.when(F.col(digest) <= F.col("_train_end"), "train")
        .when(F.col(digest) <= F.col("_validation_end"), "validation")
        .otherwise("test")
    )


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "url", seed: int = SEED,
    held_out: float = HELD_OUT, test_share: float = TEST_OF_HELD_OUT,
) -> DataFrame:
    """Append ``split`` so that every label has exactly the wanted shares.

    ``key`` must be unique. Rows are never shuffled: each is compared with the two cut
    digests of its label (a table with one row per label value, which is why it may be
    broadcast).
    """
    hashed = df.withColumn("_h", seeded_md5(F.col(key), seed))
    cuts = hash_cuts(hashed, "_h", label, _sizes(held_out, test_share))
    joined = hashed.join(F.broadcast(cuts), label, "left")
    return joined.withColumn("split", _assign("_h")).select(*df.columns, "split")


def group_split(
    df: DataFrame, key: str, seed: int = SEED,
    held_out: float = HELD_OUT, test_share: float = TEST_OF_HELD_OUT,
) -> DataFrame:
    """Append ``split``; all rows of a key share one. Exact shares of *keys*.

    The cuts come from the distinct keys; rows are then labelled by their own digest,
    so a hot key is never gathered.
    """
    hashed = df.withColumns({"_h": seeded_md5(F.col(key), seed), "_one": F.lit(1)})
    cuts = hash_cuts(hashed.select("_one", "_h").distinct(), "_h", "_one", _sizes(held_out, test_share))
    joined = hashed.join(F.broadcast(cuts), "_one", "left")
    return joined.withColumn("split", _assign("_h")).select(*df.columns, "split")


def hashed_group_split(
    df: DataFrame, key: str, seed: int = SEED,
    held_out: float = HELD_OUT, test_share: float = TEST_OF_HELD_OUT,
) -> DataFrame:
    """Like :func:`group_split` with expected instead of exact shares; a pure projection.

    A key keeps its split when the table grows.
    """
    word = leading_bits(seeded_md5(F.col(key), seed))
    train_end = int((1 - held_out) * HASH_SPACE)
    validation_end = int((1 - held_out * test_share) * HASH_SPACE)
    return df.withColumn(
        "split",
        F.when(word < train_end, "train").when(word < validation_end, "validation").otherwise("test"),
    )


def deterministic_shuffle(df: DataFrame, key: str = "url", seed: int = SEED) -> DataFrame:
    """Reproducible global order, independent of the input order."""
    return df.orderBy(seeded_md5(F.col(key), seed), key)
