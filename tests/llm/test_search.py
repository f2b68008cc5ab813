"""Both searches against comparing all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitline.llm import exact_search, near_search


def rows_of(spark, folder):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    odd = [(10_000, None), (10_050, [0.5, None]), (10_100, [float("nan")] * 64), (10_150, [float("inf")] + [0.0] * 63), (None, [0.1] * 64), (10_200, [0.0] * 64)]
    ties = [(20_000 + i, [0.25] * 64) for i in range(120)] + [(20_000, [0.25] * 64), (30_000, [0.5] * 3)]
    return given + odd + ties


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


def usable(rows):
    found = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    return [(i, np.array([*v, *[0.0] * (64 - len(v))], dtype=np.float64)) for i, v in sorted(found)]


def exact(spark, rows, k, every):
    kept = frame(spark, rows).filter(exact_search.usable(F.col("embedding")))
    vectors = kept.select("vec_id", exact_search.scaled(F.col("embedding")).alias("vector"))
    return sorted(tuple(r) for r in exact_search.exact_top_k(vectors, F.col("vec_id") % every == 0, k).collect())


def best(rows, k, every, scale):
    out = []
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-(scale(v) * scale(w)).sum(), j) for j, w in rows if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "block", "group"), [(5, 8192, 512), (7, 50, 3), (2000, 100, 10)])
def test_exact(spark, folder, monkeypatch, k, block, group):
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(exact_search, "GROUP_QUERIES", group)
    rows = rows_of(spark, folder)
    assert exact(spark, rows, k, 50) == best(usable(rows), k, 50, lambda v: np.floor(256 * v))


def test_exact_prunes_far_cells():
    pivots = np.array([[0.0, 0.0], [1000.0, 0.0]])
    cells = {c: {"nearest": [1.0, 1.0, 2.0]} for c in (0, 1)}
    least = {(g, c): d for g, c, d in exact_search._bounds(pivots, cells, {0: 1.0}, 2)}
    assert least[(0, 0)] < 0 < 900 < least[(0, 1)]


def test_no_rows_and_no_queries(spark):
    assert exact(spark, [], 5, 50) == [] and exact(spark, [(1, [1.0]), (3, [2.0])], 5, 50) == [] and exact(spark, [(50, [1.0])], 5, 50) == []


def near(spark, rows, k, factor):
    kept = frame(spark, rows).filter(exact_search.usable(F.col("embedding")))
    vectors = kept.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return sorted(tuple(r) for r in near_search.nearest(vectors, F.col("vec_id") % 20 == 0, k, factor).collect())


@pytest.mark.parametrize(("factor", "shard"), [(1.0, 16384), (1.0, 200), (near_search.FACTOR, 16384)])
def test_trees(spark, folder, monkeypatch, factor, shard):
    monkeypatch.setattr(near_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(near_search, "LEAF_ROWS", 16 if factor == 1.0 else near_search.LEAF_ROWS)
    rows = [(i, v) for i, v in usable(rows_of(spark, folder)) if v.any()]
    got = near(spark, [(i, [float(x) for x in v]) for i, v in rows], 20, factor)
    want = best(rows, 20, 20, lambda v: v)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    if factor == 1.0:
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    found = {(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}
    assert len(found) >= (0.99 if factor == 1.0 else 0.9) * len(want)
    by = dict(rows)
    assert all(r[3] == pytest.approx(float(by[r[0]] @ by[r[2]]), abs=1e-12) for r in got)


def test_trees_without_rows(spark):
    assert near(spark, [], 20, 1.0) == [] and near(spark, [(20, [1.0, 2.0])], 20, 1.0) == [] and near(spark, [(20, [0.0]), (1, None)], 20, 1.0) == []
