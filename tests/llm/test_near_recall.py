"""Recall of the vantage-point trees at the default factor, whatever the norms and the shape of the data."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from baitline.llm import near_search


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tables():
    draw = np.random.default_rng(4)
    given = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist(), dtype=float)
    even = unit(draw.normal(size=(3000, 64)))
    centres = unit(draw.normal(size=(30, 64)))
    clusters = unit(centres[draw.integers(0, 30, 3000)] + draw.normal(scale=0.03, size=(3000, 64)))
    yield "given", given
    yield "even", even
    for length in (2, 3, 10):
        yield f"one of norm {length}", np.concatenate([given, length * unit(draw.normal(size=(1, 64)))])
    yield "log-normal norms", even * draw.lognormal(0, 1, (3000, 1))
    yield "clusters", clusters
    yield "clusters of any norm", clusters * draw.lognormal(0, 1, (3000, 1))
    yield "repeats", np.concatenate([even[:1500], np.repeat(even[:15], 100, axis=0)])
    yield "one direction", np.abs(even) * draw.lognormal(0, 3, (3000, 1))
    yield "extreme norms", even * 10.0 ** draw.integers(-120, 120, (3000, 1))


def searched(vectors, factor, shards=1, k=20):
    """Queries, the best of each shard's tree, and rows looked at."""
    queries = vectors[::20]
    points = np.unique(vectors, axis=0)
    found, looked = [], 0
    for s in range(shards):
        part = points[s::shards]
        search = near_search.Search(near_search.Tree.grow(*near_search._directions(part), near_search.LEAF_ROWS), part, queries, k, factor).run()
        found.append(np.where(search.row >= 0, search.score, -np.inf))
        looked += search.looked
    best = -np.sort(-np.concatenate(found, axis=1), axis=1)[:, :k]
    want = -np.sort(-(queries @ points.T), axis=1)[:, :k]
    return float((best >= want - 1e-9 * np.abs(want)).mean()), looked / len(queries) / len(points)


@pytest.mark.parametrize(("name", "vectors"), list(tables()), ids=[n for n, _ in tables()])
def test_recall(name, vectors):
    for shards in (1, 3):
        recall, looked = searched(vectors, near_search.FACTOR, shards)
        assert recall >= 0.95 and looked <= 1
        assert searched(vectors, 1.0, shards)[0] == 1.0


def test_smaller_factors_look_at_less():
    looked = [searched(dict(tables())["clusters"], factor)[1] for factor in (0.3, near_search.FACTOR, 1.0)]
    assert looked == sorted(looked) and looked[0] < 0.3 and looked[1] < 0.65 and looked[2] < 0.75
