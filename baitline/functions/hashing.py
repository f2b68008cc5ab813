"""Hash keys that every engine can reproduce, and the buckets derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitline.functions.urls import strip

HASH_SPACE = 1 << 32


def seeded_md5(value: Column, seed: object) -> Column:
    """Hex md5 of ``seed || value``; sorting by it is a reproducible shuffle."""
    return F.md5(F.concat(F.lit(str(seed)), value.cast("string")))


def leading_bits(digest: Column, bits: int = 32) -> Column:
    """The first ``bits`` (at most 32) of a hex digest as a non-negative long."""
    word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.shiftright(word, 32 - bits)


def unit_interval(digest: Column) -> Column:
    """Digest mapped onto [0, 1]."""
    return leading_bits(digest).cast("double") / F.lit(float(HASH_SPACE - 1))


def intel_key(url: Column) -> Column:
    """Lookup key of threat reports: sha-256 of the lower-cased URL without white space around it."""
    return F.sha2(F.lower(strip(url)), 256)
