"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard.

Rows are dealt into shards by a hash of their ids and every shard is indexed by a balanced
tree of vantage points over directions, whose metric is the angle. A node knows the range
of angles between its vantage direction and each child's rows, and their shortest and
longest norm. By the triangle inequality a row of a child is at least so many radians from
the query, which with the norms bounds its inner product; a child is skipped when that
bound is below the k-th inner product found so far. ``factor`` divides the least angle:
one keeps the search exact, less skips more. Angles do not change with a vector's length,
so the factor means the same for any mix of norms. All queries of a block descend a tree
together. The trees are a written table of plain arrays.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import written

ship_with_tasks(__name__)

#: Rows of a shard, fewer where its vectors would take more than SHARD_BYTES; queries of a block; rows of a leaf.
SHARD_ROWS, SHARD_BYTES, QUERY_ROWS, LEAF_ROWS = 16384, 16 << 20, 4096, 128
#: Measured on the test tables: see the README for recall by factor.
FACTOR = 0.8
#: Angles this close count as equal.
SLACK = 1e-6


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; scaling first keeps squares of very long and very short vectors finite."""
    largest = np.abs(vectors).max(axis=1, initial=0)
    scaled = vectors / np.where(largest > 0, largest, 1)[:, None]
    norms = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / np.where(norms > 0, norms, 1)[:, None], norms * largest


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class Tree:
    """Nodes of one shard's tree as arrays. Rows of a leaf are neighbours in ``order``; a node's children are given by number, leaves by none."""

    NAMES = ("order", "vantage", "child", "span", "norm", "rows")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def grow(cls, directions: np.ndarray, norms: np.ndarray, leaf_rows: int, seed: int = 5) -> Tree:
        draw, order = np.random.default_rng(seed), []
        vantages, children, spans, lengths, leaves = [], [], [], [], []

        def add(rows: np.ndarray) -> int:
            me, n = len(children), len(rows)
            lengths.append((norms[rows].min(initial=np.inf), norms[rows].max(initial=0)))
            children.append([-1, -1])
            vantages.append(np.zeros(directions.shape[1]))
            spans.append(np.zeros((2, 2)))
            leaves.append((len(order), len(order) + n))
            if n <= leaf_rows:
                order.extend(rows.tolist())
                return me
            # of a few rows the one whose angles spread most
            some = directions[rows[draw.choice(n, min(16, n), replace=False)]]
            vantage = some[int(_angles(some, directions[rows[:: max(1, n // 256)]]).std(axis=1).argmax())]
            far = _angles(directions[rows], vantage[None])[:, 0]
            by = np.argsort(far, kind="stable")
            halves = by[:n // 2], by[n // 2:]
            vantages[me] = vantage
            spans[me] = np.array([(far[h].min(), far[h].max()) for h in halves])
            children[me] = [add(np.sort(rows[h])) for h in halves]
            return me

        add(np.arange(len(directions)))
        return cls(
            order=np.array(order, dtype=np.int64), vantage=np.array(vantages), child=np.array(children), span=np.array(spans), norm=np.array(lengths),
            rows=np.array(leaves),
        )


class Search:
    """The k rows with the largest inner products for each query, found by descending one tree."""

    def __init__(self, tree: Tree, vectors: np.ndarray, queries: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.vectors, self.queries, self.k, self.factor = tree, vectors[tree.order], queries, k, factor
        self.facing, self.length = _directions(queries)
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1, dtype=np.int64)
        self.looked = 0

    def run(self) -> Search:
        self._descend(0, np.arange(len(self.queries)))
        return self

    def _needed(self, node: int, active: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries for which a row at that least angle could still be among the best."""
        cosine = np.cos(np.minimum(np.maximum(least - SLACK, 0) / self.factor, math.pi))
        shortest, longest = self.tree.norm[node]
        bound = self.length[active] * np.where(cosine >= 0, longest, shortest) * cosine
        worst = self.score[active, -1]
        return np.isinf(worst) | (bound + np.abs(bound) * 1e-9 >= worst)

    def _descend(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        tree = self.tree
        if tree.child[node, 0] < 0:
            rows = np.arange(*tree.rows[node])
            self.looked += len(rows) * len(active)
            score = np.concatenate([self.score[active], self.queries[active] @ self.vectors[rows].T], axis=1)
            row = np.concatenate([self.row[active], np.broadcast_to(tree.order[rows], (len(active), len(rows)))], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
            self.score[active], self.row[active] = np.take_along_axis(score, best, 1), np.take_along_axis(row, best, 1)
            return
        angle = _angles(self.facing[active], tree.vantage[node][None])[:, 0]
        spans, (inner, outer) = tree.span[node], tree.child[node].tolist()
        least = [np.maximum(np.maximum(angle - high, low - angle), 0) for low, high in spans]
        inside = angle <= (spans[0][1] + spans[1][0]) / 2
        for child, bound, first in ((inner, least[0], inside), (outer, least[1], ~inside), (outer, least[1], inside), (inner, least[0], ~inside)):
            near = active[first]
            self._descend(child, near[self._needed(child, near, bound[first])])


def _builder(width: int) -> Callable:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        # rows with equal vectors are one point of the tree, with their ids in order
        vectors, point = np.unique(_matrix(rows["vector"].tolist(), width), axis=0, return_inverse=True)
        point = point.reshape(-1)
        tree = Tree.grow(*_directions(vectors), LEAF_ROWS)
        kept = io.BytesIO()
        np.savez(
            kept, ids=rows["vec_id"].to_numpy()[np.argsort(point, kind="stable")], first=np.concatenate([[0], np.cumsum(np.bincount(point))]),
            vectors=vectors, **{name: getattr(tree, name) for name in Tree.NAMES},
        )
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "index": [kept.getvalue()]})

    return build


def inner_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, as a plain loop does."""
    return np.cumsum(query * vectors, axis=1)[:, -1]


def _searcher(width: int, k: int, factor: float) -> Callable:
    def search(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(index):
            kept = np.load(io.BytesIO(index["index"].iloc[0]), allow_pickle=False)
            ids, first, vectors = kept["ids"], kept["first"], kept["vectors"]
            asked = _matrix(queries["vector"].tolist(), width)
            found = Search(Tree(**{name: kept[name] for name in Tree.NAMES}), vectors, asked, k + 1, factor).run()
            for i, name in enumerate(queries["vec_id"].tolist()):
                points = found.row[i][found.row[i] >= 0]
                # of equal vectors, only the k + 1 smallest ids can be among the k best others
                own = [ids[first[p]:min(first[p + 1], first[p] + k + 1)] for p in points]
                names = np.concatenate(own) if own else np.empty(0, np.int64)
                scores = np.repeat(inner_products(asked[i], vectors[points]), [len(x) for x in own]) if own else np.empty(0)
                order = np.lexsort((names, -scores))
                order = order[names[order] != name][:k]
                rows.append((name, names[order].tolist(), scores[order].tolist()))
        return pd.DataFrame(rows, columns=["query_id", "vec_ids", "scores"])

    return search


def nearest(vectors: DataFrame, queries: Column, k: int, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k nearest rows found among other vec_ids.

    ``vectors`` has vec_id long and vector array<double>. Score is the inner product in
    double precision, ties go to the smaller vec_id. Null vec_ids and null or zero vectors
    take no part, repeated rows count once (of a vec_id with several vectors the first in
    order), shorter vectors are filled with zeros. Every row is indexed.
    """
    spark = vectors.sparkSession
    some = F.exists("vector", lambda x: x != 0)
    usable = vectors.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(some)
    rows = written(usable.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = total["width"]
    shard_rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * width)))
    shards = math.ceil(total["n"] / shard_rows)
    asked = rows.filter(queries)
    blocks = max(1, math.ceil(asked.count() / min(QUERY_ROWS, shard_rows)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = written(dealt.groupBy("shard").applyInPandas(_builder(width), "shard int, index binary"), "trees")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    query_rows = asked.select(
        every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("part"), "vec_id", "vector",
    )
    trees = index.select("shard", every(blocks).alias("part"), "index")
    found = query_rows.groupBy("shard", "part").cogroup(trees.groupBy("shard", "part")).applyInPandas(
        _searcher(width, k, factor), "query_id long, vec_ids array<long>, scores array<double>",
    )
    flat = found.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select(
        "query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
