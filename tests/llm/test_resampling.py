"""Resampling against plain sums and sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baitline.llm import resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out, able = [], []
    for i, (doc_id, text) in enumerate(rows):
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if n >= least and doc_id is not None:
            able.append((-score, doc_id, len(own), i))
    for rank, key in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[key[3]][4] = rank
    return sorted(map(repr, out))


def rows_of(seed, n):
    draw = random.Random(seed)
    vocabulary = ["Alpha", "beta,gamma", "x1", "漢字", "don't", "ÉTÉ", "w" * 70, "y" * 64, "z" * 65, "o-o"]
    some = [(draw.randrange(n), " ".join(draw.choices(vocabulary, k=draw.randrange(40)))) for _ in range(n)]
    return some + [(None, "null id " * 20), (1, None), (2, ""), (3, "{|}~ \x7f"), (4, "v" * 100_000 + " " + "long text " * 20_000), *[(900 + i, "tie " * 30) for i in range(50)], *[(950, "same " * 25)] * 60]


@pytest.mark.parametrize(("percent", "pivots", "slices"), [(5, 24, 1 << 17), (50, 2, 7), (100, 3, 64)])
def test_against_sorting(spark, monkeypatch, percent, pivots, slices):
    monkeypatch.setattr(resampling, "SLICE_WORDS", slices)
    select = resampling.quickselect
    monkeypatch.setattr(resampling, "quickselect", lambda rows, k: select(rows, k, pivots))
    rows, target = rows_of(percent, 300), ["alpha beta gamma x1", None, "", "Tie tie tie", "漢字 été"]
    if slices < 64:
        rows = [r for r in rows if r[0] != 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(repr(list(r)) for r in resampling.resample(docs, texts, percent, 20).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == brute(rows, target, percent, 20)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.rank for r in resampling.resample(one, none).collect()] == [None]


def test_feature_buckets_are_crc32():
    text = "Some words, " + "q" * 300 + " é9 a"
    found = Counter(b for _, _, _, bucket in resampling.feature_buckets(pa.array([text])) for b in bucket.tolist())
    assert found == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text)[1])
