"""Chunked encoding equals the library's, text by text."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from baitline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SHARED = " ".join(f"Word{i * 7919 % 10007}, and" for i in range(600))
ODD = [
    None, "", " \n\t ", "a<|endoftext|>b <|startoftext|>", "x\x01y \x01 z", " hi  é ́x", "supercali" * 3000, "don't I'LL ΣΑΣ İ ﬁ 漢字かな 123 ..!? " * 200,
    "漢字かな交じり文" * 2000, "<| |> a<|b", "\x1c\x1d a\x85b c", "x " * 4000, SHARED, SHARED, "Before. " + SHARED, SHARED + " after", "mid" + SHARED + "mid" + SHARED,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    return docs + [(-i, text) for i, text in enumerate(ODD, 1)] + [(-1, None), (None, "no id")]


def test_digests(spark, folder, library):
    rows = rows_of(spark, folder)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, PATH).collect())
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want.append((str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert got == sorted(want)


def test_chunks_are_shared_and_whole():
    texts = ["left side words " * 40 + SHARED, SHARED + "right side words " * 40]
    spans = bpe._spans_of([t.encode() for t in texts])
    cores = [{t.encode()[a:b] for a, b in s} for t, s in zip(texts, spans, strict=True)]
    assert cores[0] & cores[1]
    for text, cuts in zip(texts, bpe.cut_points(pa.array(texts)), strict=True):
        assert cuts[0] == 0 and cuts[-1] == len(text.encode()) and cuts == sorted(cuts)


def test_no_rows(spark):
    assert bpe.token_digests(spark.createDataFrame([], "doc_id long, text string, ids int"), PATH).collect() == []
