"""Near duplicates against comparing all pairs of shingle sets."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from baitline.llm import near_dedup
from baitline.llm.near_dedup import Rule

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, words):
    found = [bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in WORD.findall((text or "").encode())]
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i:i + words]) for i in range(len(found) - words + 1))


def brute(rows, rule):
    sets, root = [(d, shingles(t, rule.words)) for d, t in rows], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    usable = sorted({(d, s) for d, s in sets if d is not None and s}, key=lambda x: (x[0], len(x[1])))
    for i, (d, s) in enumerate(usable):
        for e, t in usable[:i]:
            if d == e or min(len(s), len(t)) * 100 >= rule.percent * max(len(s), len(t)) and 100 * len(s & t) >= rule.percent * len(s | t):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return Counter((d, len(s), find(d) if s and d is not None else d, d is None or not s or find(d) == d) for d, s in sets)


def variants(seed, base_words, n, changes):
    """Copies of one text, each with a few words of its own, so that most but not all pairs are near."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def check(spark, rows, rule):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, rule).collect())
    assert got == brute(rows, rule)


def test_given_table_and_odd_rows(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    odd = [(-1, None), (-2, ""), (-3, "A b"), (-4, "a B"), (-5, "a b c d e"), (-6, " a b c d e "), (None, "a b c d e"), (-1, None), (3, "another text under one id here"), (-7, "another text under one id here")]
    check(spark, rows + odd, Rule(4, 80))


@pytest.mark.parametrize(("words", "short", "block"), [(60, 48, 1024), (300, 4, 8), (25, 2, 8)])
def test_large_groups_with_small_blocks(spark, monkeypatch, words, short, block):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = variants(words, words, 60, max(2, words // 30)) + [t + " " + variants(9, 40, 1, 0)[0] for t in variants(words + 1, words // 2, 20, 1)]
    passage = variants(77, words // 2, 1, 0)[0]
    texts += [passage + " " + variants(100 + i, words // 2, 1, 0)[0] for i in range(30)]
    check(spark, list(enumerate(texts)) + [(500 + i, texts[i]) for i in range(10)], Rule(5, 80))


def test_no_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_form_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (4, None, "w")], "doc_id long, text string, kept string")
    rows = near_dedup.without_near_copies(docs).collect()
    assert sorted((str(r.doc_id), r.kept) for r in rows) == [("1", "x"), ("4", "w"), ("None", "z")]


def test_low_estimates_are_verified(spark):
    """Near texts whose union sketch shares 24 of 48 values: the exact sets decide."""
    words = [f"word{i}" for i in range(3000)]
    hashes = [int(next(near_dedup.shingle_sets(pa.array([w]), 1))[0]) for w in words]
    ranked = [w for _, w in sorted(zip(hashes, words, strict=True))]
    common = ranked[24:624]
    rows = [(1, " ".join([*ranked[0:24:2], *common])), (2, " ".join([*ranked[1:24:2], *common])), (3, " ".join(ranked[700:1300]))]
    lows = [next(near_dedup.shingle_sets(pa.array([t]), 1))[:near_dedup.SKETCH] for _, t in rows[:2]]
    assert near_dedup.union_estimate(*lows) == 0.5
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Rule(1, 80)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}
