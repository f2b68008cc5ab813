"""Word hashes: words that a polynomial modulo a power of two cannot tell apart are told apart by every operator that compares words by hash."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from baitline.llm import bpe, lm, near_dedup, words
from baitline.llm.words import equal_spans, hash_spans, runs

PATH = public_tokenizers.path("word_bpe_49k.json")


def twins(doublings=11):
    """The Thue-Morse word over a and b and its complement, behind equal first letters."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return "prefixed" + word, "prefixed" + word.translate(str.maketrans("ab", "ba"))


def test_hashes():
    for doublings in (4, 7, 11):
        left, right = twins(doublings)
        hashes = next(runs(pa.array([f"{left} {right} {left}"]))).hashes.tolist()
        assert hashes[0] == hashes[2] != hashes[1]
    many = ["".join(p) for n in range(1, 11) for p in np.array(list("ab"))[np.indices((2,) * n).reshape(n, -1).T]]
    many += ["x" * n for n in range(1, 600)] + ["é" * n + "\x00" * k for n in range(1, 40) for k in range(20)]
    found = np.concatenate([r.hashes for r in runs(pa.array([" ".join(many)]), lower=False)])
    assert len(found) == len(many) == len(set(found.tolist()))


def test_equal_spans():
    data = np.frombuffer(b"abcdefghijklmnop" * 40, np.uint8)
    size = np.array([0, 1, 7, 8, 9, 16, 300, 16, 300])
    start, other = np.zeros(9, np.int64), np.array([5, 0, 0, 16, 16, 32, 16, 1, 1])
    assert equal_spans(data, start, data, other, size).tolist() == [True] * 7 + [False] * 2
    assert len(hash_spans(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_parts_of_a_run():
    run = next(runs(pa.array(["a b c", "", "d", "e f g h"])))
    parts = list(run.parts(3, beyond=1))
    assert [(p.counts.tolist(), own) for p, own in parts] == [([3, 0, 1, 0], 3), ([0, 0, 1, 3], 3), ([0, 0, 0, 2], 2)]


def test_bpe_compares_bytes(monkeypatch):
    library, texts = Tokenizer.from_file(PATH), [*twins(), " ".join(twins(5)), "plain words here", " ".join(f"word{i} Other{i}" for i in range(50))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bpe.WordCoder(PATH).encode([t.encode() for t in texts])] == want
    # even if all words had one hash
    monkeypatch.setattr(words, "hash_spans", lambda data, start, end: np.zeros(len(start), np.uint64))
    coder = bpe.WordCoder(PATH)
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts])] == want
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts])] == want


def test_near_dedup_and_models(spark):
    left, right = twins()
    docs = spark.createDataFrame([(1, f"{left} one two three"), (2, f"{right} one two three"), (3, f"{left} one two three")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, near_dedup.Rule(4, 80)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    good = spark.createDataFrame([(1,)], "good_id long")
    losses = {r.doc_id: r.target_loss for r in lm.score(docs, good).collect()}
    assert losses[1] == losses[3] < losses[2]


def test_digests_of_twins(spark):
    library, rows = Tokenizer.from_file(PATH), list(enumerate(twins()))
    got = {r.doc_id: r.ids_sha256 for r in bpe.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {i: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in rows}
