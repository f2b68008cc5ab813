"""Resampling documents towards a target distribution, the winners found by distributed quickselect.

Hashed n-gram counts of the documents and of the target texts give every bucket a gain:
the logarithm of how much likelier it is in the target. A document's weight is the sum of
its features' gains, read off one array, and Gumbel noise drawn from its id turns the
highest scores into a draw without replacement.

The cut below the last winner is a composite key (score, doc_id, n_features). Each round
takes a few random keys of the range that is left as pivots and counts, exactly, the rows
between and at them; the counts name the next range, until a pivot is the key itself. Only
winners are sorted, by ranges, and ranked.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import bounded_batches, written
from baitline.llm.words import runs
from baitline.llm.worker import tidy

ship_with_tasks(__name__)

BUCKETS, LONGEST_GRAM, SCALE = 10_000, 3, 1000
#: Pivots of a round.
PIVOTS = 24
#: Words that are worked on together, so that a very long text is held in parts.
SLICE_WORDS = 1 << 17
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 64
#: What stands between words: all of ASCII but digits and, after lower-casing, letters.
BREAKS = np.ones(256, dtype=bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False


def _byte_table() -> np.ndarray:
    """What CRC-32 (reflected polynomial 0xEDB88320) makes of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


def _shift_tables(byte: np.ndarray) -> np.ndarray:
    """(LONG_WORD + 2, 4, 256): what each byte of a CRC becomes when so many zero bytes follow."""
    out = np.zeros((LONG_WORD + 2, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(out)):
        out[n] = byte[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_BYTE = _byte_table()
_SHIFT = _shift_tables(_BYTE)


def _shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), dtype=np.uint32)
    for k in range(4):
        out ^= _SHIFT[zeros, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shifted_far(crc: int, zeros: int) -> int:
    """As ``_shifted`` for one value and any number of zero bytes, by squaring."""
    power = [1 << k for k in range(32)]
    step = [int(_shifted(np.array([x], np.uint32), np.array([1]))[0]) for x in power]
    apply = lambda matrix, x: functools.reduce(lambda a, k: a ^ matrix[k] if x >> k & 1 else a, range(32), 0)
    while zeros:
        if zeros & 1:
            crc = apply(step, crc)
        step = [apply(step, x) for x in step]
        zeros >>= 1
    return crc


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes between each start and end."""
    size = end - start
    state = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    rows = np.flatnonzero(size <= LONG_WORD)
    for j in range(int(size[rows].max(initial=0))):
        rows = rows[size[rows] > j]
        x = state[rows]
        state[rows] = _BYTE[(x ^ data[start[rows] + j]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes())
    return out


def _joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of left, one space and right; ``size`` is the length of right in bytes."""
    space = np.uint32(zlib.crc32(b" "))
    out = np.zeros(len(left), dtype=np.uint32)
    near = size <= LONG_WORD
    n = size[near]
    out[near] = _shifted(left[near], n + 1) ^ _shifted(np.full(len(n), space, np.uint32), n) ^ right[near]
    for i in np.flatnonzero(~near).tolist():
        n = int(size[i])
        out[i] = _shifted_far(int(left[i]), n + 1) ^ _shifted_far(int(space), n) ^ int(right[i])
    return out


def feature_buckets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: the first text's row, the words counted for each text, and text and bucket of every feature.

    Features are all runs of one to LONGEST_GRAM consecutive words joined by one space.
    """
    for run in runs(texts, breaks=BREAKS):
        n, of = len(run.counts), run.text_of()
        size = run.ends - run.starts
        for low in range(0, max(1, len(of)), SLICE_WORDS):
            # the words before a slice end grams that began in the last one
            back = max(0, low - LONGEST_GRAM + 1)
            at = slice(back, low + SLICE_WORDS)
            word, own, long = word_crcs(run.data, run.starts[at], run.ends[at]), of[at], size[at]
            fresh = np.arange(back, back + len(own)) >= low
            gram, last = word, np.arange(len(word))
            found = [(own[fresh], word[fresh])]
            for _ in range(LONGEST_GRAM - 1):
                # grams that end at word i go on with word i + 1 of the same text
                ok = np.flatnonzero(last + 1 < len(word))
                ok = ok[own[last[ok] + 1] == own[last[ok]]]
                gram, last = _joined(gram[ok], word[last[ok] + 1], long[last[ok] + 1]), last[ok] + 1
                found.append((own[last][fresh[last]], gram[fresh[last]]))
            text = np.concatenate([f[0] for f in found])
            bucket = (np.concatenate([f[1] for f in found]) % np.uint32(BUCKETS)).astype(np.int64)
            yield run.row, np.bincount(own[fresh], minlength=n), text, bucket


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, _, _, bucket in feature_buckets(batch.column("text")):
            counts += np.bincount(bucket, minlength=BUCKETS)
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(counts)], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket; tasks send one array each."""
    rows = texts.select("text").mapInArrow(tidy(_count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))) for each bucket."""
    s, t = source.tolist(), target.tolist()
    all_s, all_t = sum(s) + BUCKETS, sum(t) + BUCKETS
    return np.array([math.floor(SCALE * math.log(float((y + 1) * all_s) / float((x + 1) * all_t))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def _weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), dtype=np.int64)
            for row, words, text, bucket in feature_buckets(batch.column("text")):
                at = slice(row, row + len(words))
                sums[0, at] += words
                sums[1, at] += np.bincount(text, minlength=len(words))
                # every part of a sum is a whole number below 2**53
                sums[2, at] += np.bincount(text, weights=gain[bucket], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(-SCALE * ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of the SHA-256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Key:
    """A place in the order of the draw: high scores first, then small doc_ids, then few features."""

    score: int
    doc_id: int
    n_features: int

    def order(self) -> tuple[int, int, int]:
        return -self.score, self.doc_id, self.n_features

    def is_after(self) -> Column:
        """Whether this key comes after the row's."""
        score, doc_id = F.col("score"), F.col("doc_id")
        return (score > self.score) | ((score == self.score) & (
            (doc_id < self.doc_id) | ((doc_id == self.doc_id) & (F.col("n_features") < self.n_features))
        ))

    def is_row(self) -> Column:
        return (F.col("score") == self.score) & (F.col("doc_id") == self.doc_id) & (F.col("n_features") == self.n_features)


def quickselect(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[Key, int]:
    """The k-th key of ``rows`` in the order of the draw (from 1, at most the rows), and how many rows come before it."""
    before, left, turn = 0, rows, 0
    while True:
        picked = left.orderBy(F.xxhash64("doc_id", F.lit(turn)), "score", "doc_id", "n_features").limit(pivots)
        keys = sorted({Key(r["score"], r["doc_id"], r["n_features"]) for r in picked.select("score", "doc_id", "n_features").collect()}, key=Key.order)
        # 2 * i: between pivots i - 1 and i; 2 * i + 1: at pivot i
        steps = [F.when(p.is_after(), 0).when(p.is_row(), 1).otherwise(2) for p in keys]
        part = functools.reduce(lambda a, b: a + b, steps)
        counts = {r["part"]: r["n"] for r in left.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for at in range(2 * len(keys) + 1):
            n = counts.get(at, 0)
            if before + n >= k:
                break
            before += n
        if at % 2:
            return keys[at // 2], before
        if at // 2 < len(keys):
            left = left.filter(keys[at // 2].is_after())
        if at:
            low = keys[at // 2 - 1]
            left = left.filter(~low.is_after() & ~low.is_row())
        turn += 1


def _ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their places: ranges are sorted and numbered apart, and offset by the rows of earlier ranges."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    spark = winners.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = winners.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "winners")
    split = 1 << 33
    before, offsets = 0, []
    # one row for each partition
    for row in placed.groupBy(F.floor(F.col("at") / split).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():
        offsets.append((row["range"], before))
        before += row["n"]
    table = F.broadcast(spark.createDataFrame(offsets, "range long, before long"))
    numbered = placed.withColumn("range", F.floor(F.col("at") / split)).join(table, "range")
    return numbered.withColumn("rank", F.col("before") + F.col("at") % split + 1)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of documents; rank is null where a row is not drawn.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, the
    highest scores first, ties to the smaller doc_id. Null and empty texts have no features
    and weight 0. Repeated rows each count and are each drawn or not; of equal ones any. A
    row with a null doc_id counts for the buckets, has no score and is never drawn. Other
    columns are left out. The driver holds two arrays of BUCKETS numbers.
    """
    bounded_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = rows.mapInArrow(tidy(_weigher(gain)), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")
    able = scored.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words))
    k = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = lambda df: df.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not k:
        return rest(scored)
    cut, before = quickselect(able, k)
    unable = scored.filter(F.col("doc_id").isNull() | (F.col("n_words") < least_words))
    losers = able.filter(~cut.is_after() & ~cut.is_row())
    # rows at the cut are equal in all columns: the first places go to any of them
    level = able.filter(cut.is_row()).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    level = level.select(*columns, F.explode(F.sequence(F.lit(before + 1), before + F.col("n"))).alias("place"))
    level = level.select(*columns, F.when(F.col("place") <= k, F.col("place")).alias("rank"))
    ahead = able.filter(cut.is_after())
    drawn = _ranked(ahead).select(*columns, "rank") if before else rest(ahead)
    return drawn.unionByName(level).unionByName(rest(losers)).unionByName(rest(unable))
