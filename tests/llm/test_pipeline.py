"""The pipeline's stages by brute force, and the registered queries against their SQL."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import connect, difference
from test_near_dedup import brute
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from baitline.llm import toxicity
from baitline.llm.near_dedup import Rule
from baitline.llm.oracle import ORACLE_SQL
from baitline.llm.queries import QUERIES
from baitline.llm.tables import written


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, folder), name)
        kept[name] = (before, docs)
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(before, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == {d for d, p in scores.items() if not p}
    before, after = kept["near_dedup"]
    stay = {d for (d, _, _, keep) in brute([(r.doc_id, r.text) for r in before.collect()], Rule(5, 80)) if keep}
    assert after.columns == columns and Counter(r.doc_id for r in after.collect()) == Counter(stay)
    before, after = kept["mixing"]
    assert after.columns == columns and {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect()}
    before, after = kept["bpe"]
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in before.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect()) == sorted(want)


def test_stages_without_rows_and_with_odd_ones(spark, folder):
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 20_000, None, None, 1)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, folder), name)
        assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE_SQL[name]) is None


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
