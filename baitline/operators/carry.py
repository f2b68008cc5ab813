"""Ordered scans with a carried state, cut into chunks that any key may span.

Rows are laid out by ranges of (key, order), so a key with very many rows spreads over
as many chunks as its rows need. Every chunk is scanned on its own, first as if nothing
came before it; what it leaves open is one small state. In chunk order those states are
handed on: a chunk that begins inside a key gets what the chunk before left, and where
that changes what it leaves itself (it holds no other key) it is scanned again. States
forget quickly, so few chunks are. The driver holds one state per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baitline.functions.shipping import ship_with_tasks
from baitline.session import cut_lineage

ship_with_tasks(__name__)

#: The machine that a scan runs: columns of one key's neighbouring rows and the state before them give new columns and the state after.
Machine = Callable[[dict[str, np.ndarray], list[int] | None], tuple[dict[str, np.ndarray], list[int]]]


def _key_runs(keys: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct neighbouring keys and where their rows begin and end."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
    return [coded.dictionary[int(codes[e])].as_py() for e in edges[:-1]], edges


def _scan(batches: Iterator[pa.RecordBatch], key: str, machine: Machine, reads: list[str], entering: dict[int, list[int]]):
    """Each batch with its new columns; ends with the chunk's number, first and last key, and the state that is left."""
    chunk, first, last, state = None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, edges = _key_runs(batch.column(key))
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in reads}
        if chunk is None:
            chunk, first, last = batch.column("_chunk")[0].as_py(), names[0], names[0]
            state = entering.get(chunk)
        parts = []
        for name, low, high in zip(names, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if name != last:
                last, state = name, None
            made, state = machine({c: v[low:high] for c, v in columns.items()}, state)
            parts.append(made)
        yield batch, {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    yield None, (chunk, first, last, state)


def carried_scan(
    df: DataFrame, key: str, order: list[str], machine: Machine, reads: list[str], adds: list[str], chunks: int | None = None,
) -> DataFrame:
    """``df`` with the long columns ``adds`` that ``machine`` makes of the columns ``reads``, key by key in ``order``.

    Neither ``key``, a string, nor a column in ``reads`` is ever null. ``order`` should make rows of a key
    unique; rows equal in it may take each other's place. States are lists of whole
    numbers. A value below zero in a new column stands for null. Without ``chunks`` the
    session's shuffle partitions say how many there are.
    """
    keys = [F.col(c) for c in (key, *order)]
    laid = df.repartitionByRange(chunks, *keys) if chunks else df.repartitionByRange(*keys)
    laid = cut_lineage(laid.sortWithinPartitions(*keys).withColumn("_chunk", F.spark_partition_id()))

    def ends(entering: dict[int, list[int]], wanted: DataFrame) -> dict:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _scan(batches, key, machine, reads, entering):
                if batch is None and found[0] is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip(found, (pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)],
                        names=["chunk", "first", "last", "state"],
                    )

        narrow = wanted.select("_chunk", key, *reads)
        # one row for each chunk
        return {r["chunk"]: r for r in narrow.mapInArrow(scan, "chunk int, first string, last string, state array<long>").collect()}

    left = ends({}, laid)
    entering: dict[int, list[int]] = {}
    while True:
        again, before = [], None
        for chunk in sorted(left):
            row = left[chunk]
            state = list(before["state"]) if before is not None and before["last"] == row["first"] else None
            if state != entering.get(chunk):
                entering[chunk] = state
                if row["first"] == row["last"]:
                    again.append(chunk)
            before = row
        entering = {c: s for c, s in entering.items() if s is not None}
        if not again:
            break
        left |= ends(entering, laid.where(F.col("_chunk").isin(again)))

    fields = [f for f in laid.schema.fields if f.name != "_chunk"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _scan(batches, key, machine, reads, entering):
            if batch is not None:
                new = [pa.array(made[c], pa.int64(), mask=made[c] < 0) for c in adds]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *new], names=[*(f.name for f in fields), *adds])

    return laid.mapInArrow(place, T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in adds]]))
