"""Exact top-k search by inner product of integer vectors: a Voronoi kNN join.

With one more coordinate that lifts all data to the same length, the largest inner
product is the smallest distance. Data and queries go to their nearest of a few pivots.
A summary of each cell (rows, radius, its rows nearest to the pivot) bounds, for each group
of queries, how far its k-th neighbour can be; a data row is copied only to the groups it
can be near enough to. Every group meets the data in blocks of bounded size, keeps k rows
per query and block, and the blocks' winners are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import written

ship_with_tasks(__name__)

#: There is a pivot for each so many of the square root of the rows, 2 at least and MOST_PIVOTS at most.
ROWS_ROOT_PER_PIVOT, MOST_PIVOTS = 32, 256
#: Rows of a data block and queries of a group.
BLOCK_ROWS, GROUP_QUERIES = 8192, 512


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return F.coalesce(
        vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False),
    )


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _lift(vectors: np.ndarray, square: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assigner(pivots: np.ndarray, width: int, square: float, query: Callable) -> Callable:
    """Rows (id, vector) with their cell and distance to its pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector").to_pylist(), width)
            lifted = query(x) if query else _lift(x, square)
            d = _distances(lifted, pivots)
            cell = d.argmin(axis=1) if len(d) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "vector", "cell", "far"],
            )

    return assign


def _flat(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; ``ids`` must ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.argsort(-scores[among], kind="stable")][:k]


def _solver(k: int, width: int) -> Callable:
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id")
            ids = data["vec_id"].to_numpy()
            q, x = _matrix(queries["vector"].tolist(), width), _matrix(data["vector"].tolist(), width)
            small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2.0**52
            products = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if small else q @ x.T
            for query, scores in zip(queries["vec_id"].tolist(), products, strict=True):
                other = np.flatnonzero(ids != query)
                for at in other[best_rows(scores[other], ids[other], k)]:
                    rows.append((query, int(ids[at]), int(scores[at])))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return solve


def _bounds(pivots: np.ndarray, cells: dict, radii: dict, k: int) -> list[tuple[int, int, float]]:
    """For each group of queries and cell of data the least distance to the pivot that a needed row can have."""
    between = _distances(pivots, pivots)
    needed = []
    for g, radius in radii.items():
        reach = sorted(radius + between[g, c] + d for c, cell in cells.items() for d in cell["nearest"])
        limit = reach[k] if len(reach) > k else math.inf
        slack = 1e-6 * (1 + between.max() + radius)
        needed += [(g, c, between[g, c] - radius - limit - slack) for c in cells]
    return needed


def exact_top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k rows of other vec_ids with the largest inner products.

    ``vectors`` has vec_id long and vector array<long>; ties go to the smaller vec_id. Rows
    with a null vec_id or vector take no part, repeated rows count once, a shorter vector
    is filled with zeros. Products must fit 64 bits. Without queries, or without other
    rows, the result is empty. The driver holds the pivots and one summary per cell.
    """
    spark = vectors.sparkSession
    rows = written(vectors.filter("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector").distinct(), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square"), F.max(F.size("vector")).alias("width")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    width, longest = max(1, total["width"]), total["square"]
    wanted = min(MOST_PIVOTS, max(2, round(math.sqrt(total["n"]) / ROWS_ROOT_PER_PIVOT)))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    pivots = _lift(_matrix([r["vector"] for r in picked], width), longest)
    placed_schema = "vec_id long, vector array<long>, cell int, far double"
    data = written(rows.mapInArrow(_assigner(pivots, width, longest, None), placed_schema), "cells")
    asked = written(rows.filter(queries).mapInArrow(_assigner(pivots, width, longest, _flat), placed_schema), "queries")

    near = Window.partitionBy("cell").orderBy("far", "vec_id")
    nearest = data.select("cell", "far", F.row_number().over(near).alias("place")).filter(F.col("place") <= k + 1)
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(
        nearest.groupBy("cell").agg(F.collect_list("far").alias("nearest")), "cell").collect()}
    groups = {r["cell"]: r for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    needed = _bounds(pivots, cells, {g: r["radius"] for g, r in groups.items()}, k)
    split = {c: math.ceil(r["n"] / BLOCK_ROWS) for c, r in cells.items()}
    parts = {g: math.ceil(r["n"] / GROUP_QUERIES) for g, r in groups.items()}
    # at most MOST_PIVOTS ** 2 rows, whatever the data
    meet = spark.createDataFrame(
        [(g, parts[g], c, split[c], float(least)) for g, c, least in needed], "g int, parts int, c int, blocks int, least double",
    )
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    data_rows = data.join(F.broadcast(meet), (F.col("cell") == F.col("c")) & (F.col("far") >= F.col("least"))).select(
        F.col("g").alias("group"), each("parts").alias("part"), F.col("c").alias("of"), dealt("blocks").alias("block"), "vec_id", "vector",
    )
    query_rows = asked.join(F.broadcast(meet), F.col("cell") == F.col("g")).select(
        F.col("g").alias("group"), dealt("parts").alias("part"), F.col("c").alias("of"), each("blocks").alias("block"), "vec_id", "vector",
    )
    keys = ["group", "part", "of", "block"]
    found = query_rows.groupBy(*keys).cogroup(data_rows.groupBy(*keys)).applyInPandas(_solver(k, width), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
