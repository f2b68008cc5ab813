"""Passage removal against comparing all windows, and the automaton against plain search."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from baitline.llm import substring_dedup
from baitline.llm.substring_dedup import Automaton, repeated_passages, sliding_minimum, span_hashes

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, words in split:
        for p in range(len(words) - window + 1) if d is not None else ():
            key = tuple(words[p:p + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for p in range(len(words) - window + 1) if d is not None else ():
            if first[tuple(words[p:p + window])] < d:
                gone.update(range(p, p + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((str(d), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, window):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("x")).withColumn("id", F.lit(1)).withColumn("anchors", F.lit(2))
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeated_passages(docs, window).collect())


def prose(seed, n, alphabet=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(alphabet)}" for _ in range(n))


PASSAGE, LONG = prose(1, 60), prose(2, 300)
ODD = [
    (None, PASSAGE), (None, None), (7, None), (8, ""), (9, " \n\t "), (10, "a b c"), (11, PASSAGE), (11, PASSAGE), (11, "x " + PASSAGE), (5, "y\n" + PASSAGE.replace(" ", "\t")),
    (20, "w " * 3000), (21, "w " * 3001), (22, "z" * 5000 + " " + "w " * 80), (30, LONG), (31, LONG + " tail"), (32, "head " + LONG), (33, LONG), (-4, LONG[300:1500]),
    (40, prose(3, 40) + " " + PASSAGE + " " + prose(4, 40)), (41, prose(5, 45) + " " + PASSAGE.upper()), (42, "é\xa0 " + PASSAGE + "\x0b" + PASSAGE),
]


@pytest.mark.parametrize(("window", "slices", "blocks"), [(50, 1 << 17, 4000), (50, 100, 3), (16, 64, 5)])
def test_odd_texts(spark, monkeypatch, window, slices, blocks):
    monkeypatch.setattr(substring_dedup, "SLICE_WORDS", slices)
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", blocks)
    monkeypatch.setattr(substring_dedup, "BLOCK_SEGMENTS", blocks)
    assert got(spark, ODD, window) == brute(ODD, window)


def test_hot_passage_between_own_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_SEGMENTS", 16)
    rows = [(i, prose(1000 + i, 30) + " " + LONG[:700] + " " + prose(5000 + i, 30)) for i in range(300)] + [(1000 + i, LONG) for i in range(100)]
    assert got(spark, rows, 50) == brute(rows, 50)


def test_kept_text(spark):
    rows = [(1, PASSAGE), (2, "left " + PASSAGE + " right"), (3, PASSAGE), (4, "other words")]
    kept = {r.doc_id: r.kept_text for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {1: None, 2: "left right", 3: None, 4: None}


def test_no_rows(spark):
    assert got(spark, [], 50) == [] and got(spark, [(1, None)], 50) == brute([(1, None)], 50)


def test_automaton_against_search():
    draw = random.Random(3)
    for _ in range(40):
        sequences = [([draw.randrange(3) for _ in range(draw.randrange(1, 40))], draw.randrange(9)) for _ in range(4)]
        automaton = Automaton()
        for words, doc in sequences:
            automaton.add(words, doc)
        automaton.finish()
        asked = [draw.randrange(4) for _ in range(60)]
        want = []
        for p in range(len(asked) - 4):
            held = [doc for words, doc in sequences if any(words[i:i + 5] == asked[p:p + 5] for i in range(len(words) - 4))]
            want += [(p, min(held))] if held else []
        assert automaton.first_documents(asked, 5) == want


def test_fingerprints():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    assert sliding_minimum(x, 35).tolist() == [min(x[i:i + 35]) for i in range(166)]
    assert len(span_hashes(x, 50)) == 151 and (span_hashes(x[3:60], 50)[0] == span_hashes(x, 50)[3]) and len(span_hashes(x[:50], 50)) == 1
