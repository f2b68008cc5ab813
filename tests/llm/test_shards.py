"""Sharding against a plain walk down the same tree."""

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import replace

from baitline.llm import shards

LEAVES = shards.layout(2, 2, 2)
ROWS = [(i, f"text {i % 7}", "x", 9) for i in range(400)] + [(3, "text 3", "y", 1), (3, "text 3", "y", 1), (None, "é" * 5000, "x", 2), (-5, None, None, None), (-6, "", "z", 0)]


def draw(key, level, node):
    return (int(hashlib.md5(f"{key}/{level}/{node}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def walk(key, leaves):
    for level in ("region", "rack", "shard"):
        weights = {}
        for x in leaves:
            weights[getattr(x, level)] = weights.get(getattr(x, level), 0) + x.weight
        best = min((n for n in weights if weights[n] > 0), key=lambda n: (-math.log(draw(key, level, n)) / weights[n], n))
        leaves = [x for x in leaves if getattr(x, level) == best]
    return leaves[0].shard


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, n int")


def test_rows_and_slots(spark):
    rows = shards.shard_documents(frame(spark), LEAVES, buckets=4).collect()
    want = Counter()
    for doc_id, text, *_ in ROWS:
        key, body = "null" if doc_id is None else str(doc_id), (text or "").encode()
        want[(doc_id, len(body) + 1, zlib.crc32(body), "key", walk(key, LEAVES), walk(key, shards.grown(LEAVES)))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_one_more_shard_only_takes(spark):
    rows = shards.shard_documents(frame(spark), LEAVES).collect()
    new = max(x.shard for x in LEAVES) + 1
    assert all(r.grown_shard in (r.shard, new) for r in rows) and any(r.grown_shard == new for r in rows)


def test_new_weights_move_rows_in_their_subtrees_only():
    heavier = [replace(x, weight=3.0) if x.shard == 6 else x for x in LEAVES]
    for key in map(str, range(500)):
        old, new = walk(key, LEAVES), walk(key, heavier)
        assert old == new or new >= 4  # shards 4 to 7 are the region of the heavier one


def test_no_rows(spark):
    assert shards.shard_documents(frame(spark, []), LEAVES).collect() == []
