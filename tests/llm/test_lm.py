"""Cross-entropy difference against counting word by word."""

import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from baitline.llm import lm
from baitline.llm.words import runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [(1, "Good words, good order"), (2, "bad bad words"), (3, None), (4, ""), (5, "good   ORDER\tof\nwords é漢"), (None, "good words"), (6, "x " * 3000), (1, "Good words, good order")]


def lowered(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in WORD.findall((text or "").encode())]


@pytest.mark.parametrize("run_bytes", [1, 40, 1 << 20])
def test_words(run_bytes):
    texts = [t for _, t in TEXTS] + [" \x0b", "\x00a \x1f b"]
    found = [[bytes(r.data[a:b]) for a, b in zip(r.starts[i:j], r.ends[i:j], strict=True)] for r in runs(pa.array(texts), run_bytes=run_bytes) for i, j in zip(r.first[:-1], r.first[1:], strict=True)]
    assert found == [lowered(t) for t in texts]


def classes(text):
    """(word, history, pair) classes of a text, each word hashed by itself."""
    out, before = [], lm.VOCABULARY
    for w in lowered(text):
        run = next(runs(pa.array([w.decode()])))
        word = int(run.hashes[0] % lm.VOCABULARY)
        z = (before * (lm.VOCABULARY + 1) + word) * 0xD6E8FEB86659FD93 % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        out.append((word, before, (z ^ z >> 31) % lm.PAIRS))
        before = word
    return out


def losses(docs, target):
    """Mean losses of every text under models counted with dictionaries."""
    result = []
    counts = []
    for chosen in (target, docs):
        counted = [Counter(c[k] for _, t in chosen for c in classes(t)) for k in range(3)]
        counts.append(counted)
    mass = sum(counts[0][0].values())
    for _, text in docs:
        means = []
        for word, history, pair in counts:
            scale = mass / max(1, sum(word.values()))
            total = 0.0
            for w, h, p in classes(text):
                unigram = (word[w] * scale + lm.UNIGRAM_PRIOR) / (sum(word.values()) * scale + lm.UNIGRAM_PRIOR * lm.VOCABULARY)
                total -= math.log((pair[p] * scale + lm.BIGRAM_PRIOR * unigram) / (history[h] * scale + lm.BIGRAM_PRIOR))
            means.append(total / max(1, len(classes(text))))
        result.append((len(classes(text)), *means))
    return result


def test_scores(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 7)] + [(1, 0, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    target = [(d, t) for d, t in TEXTS if d is not None and d % 2 and not held(d)]
    want = sorted((str(d), *x) for (d, _), x in zip(TEXTS, losses(TEXTS, target), strict=True))
    got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in lm.cross_entropy_difference(docs, labels).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:] == pytest.approx(w[2:], rel=1e-4)


def test_good_documents_score_lower(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = lm.cross_entropy_difference(docs, labels).filter("held_out").join(labels, "doc_id").select("quality", "score").collect()
    good, poor = (sorted(r.score for r in rows if r.quality == q) for q in (1, 0))
    wins = sum(sum(g < p for g in good) for p in poor) / (len(good) * len(poor))
    assert wins > 0.6


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.cross_entropy_difference(none, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def exact_losses(docs, target):
    """Mean losses under models that count the words themselves."""
    spread = lambda t: list(zip([None, *lowered(t)], lowered(t)))  # noqa: B905, E731
    counts = [[Counter(k(x) for _, t in chosen for x in spread(t)) for k in (lambda x: x[1], lambda x: x[0], lambda x: x)] for chosen in (target, docs)]
    size = max(lm.VOCABULARY, len(counts[1][0]))
    mass = sum(counts[0][0].values())
    out = {}
    for doc_id, text in docs:
        means = []
        for word, history, pair in counts:
            scale = mass / max(1, sum(word.values()))
            p = lambda x: (pair[x] * scale + lm.BIGRAM_PRIOR * (word[x[1]] * scale + lm.UNIGRAM_PRIOR) / (mass + lm.UNIGRAM_PRIOR * size)) / (history[x[0]] * scale + lm.BIGRAM_PRIOR)  # noqa: B023, E731
            means.append(sum(-math.log(p(x)) for x in spread(text)) / max(1, len(spread(text))))
        out[doc_id] = means
    return out


@pytest.mark.parametrize("chunk_bytes", [50_000, 1 << 24])
def test_many_words_share_nothing(spark, chunk_bytes):
    """More words than classes of 16 bits, more pairs than 20 bits: no word or pair takes another's counts."""
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{min(int(rng.paretovariate(0.25)), 10**9)}" for _ in range(2000))) for i in range(700)]
    good = [i for i in range(0, 700, 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = lm.score(docs, spark.createDataFrame([(i,) for i in good], "good_id long"), chunk_bytes).collect()
    want = exact_losses(texts, [texts[i] for i in good])
    assert len({w for _, t in texts for w in t.split()}) > 1 << 16
    assert sorted(r.doc_id for r in got) == list(range(700))
    for r in got:
        assert [r.target_loss, r.background_loss] == pytest.approx(want[r.doc_id], rel=1e-9)
        assert min(r.target_loss, r.background_loss) > 0
