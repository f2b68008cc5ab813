"""Vector code compression: product quantisation whose entries are found by Orchard's search.

Vectors are cut into equal parts and each part position has a codebook of a few entries.
For every entry the other entries are listed by their distance from it. A search starts at
one entry and walks its list: an entry that is nearer to the query is jumped to and its
list is walked instead, entries seen before are marked and skipped, and the walk ends at
the first entry farther from the current one than twice the query's distance, which no
better entry can be. All distances are squares of whole numbers, so ties are exact.

A round of fitting is one pass: tasks search for all parts of their rows and send, for
each part position, entry and component, a sum and a count. The driver holds only the
codebooks, whose size the caller sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import discard, written
from baitline.llm.worker import tidy

ship_with_tasks(__name__)

#: Components are held within this bound, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Rows searched together.
ROWS = 4096


def whole_components(vector: Column, scale: int = 4096) -> Column:
    """floor(scale * x) of every component x as double, as long within +-LARGEST."""
    held = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x.cast("double") * scale).cast("double")))
    return F.transform(vector, lambda x: held(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double")))).cast("long"))


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by squared distance, ties by index, and those distances."""
    gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    return order, np.take_along_axis(gap, order, axis=1)


def orchard(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each point (ties to the lower index), its squared distance, and how many distances were computed."""
    order, gap = neighbour_lists(entries)
    n, k = len(points), len(entries)
    current = np.zeros(n, dtype=np.int64)
    best = ((points - entries[0]) ** 2).sum(axis=1) if n else np.empty(0, np.int64)
    marked = np.zeros((n, k), dtype=bool)
    marked[:, 0] = True
    at, looked, walking = np.zeros(n, dtype=np.int64), n, np.arange(n)
    while len(walking):
        # a list's end, or an entry beyond twice the distance (four times its square), ends the walk
        place = np.minimum(at[walking], k - 1)
        walking = walking[(at[walking] < k) & (gap[current[walking], place] <= 4 * best[walking])]
        met = order[current[walking], at[walking]]
        at[walking] += 1
        new = ~marked[walking, met]
        rows, met = walking[new], met[new]
        marked[rows, met] = True
        looked += len(rows)
        far = ((points[rows] - entries[met]) ** 2).sum(axis=1)
        nearer = (far < best[rows]) | ((far == best[rows]) & (met < current[rows]))
        jump = rows[nearer]
        current[jump], best[jump], at[jump] = met[nearer], far[nearer], 0
    return current, best, looked


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _summer(books: np.ndarray) -> Callable:
    parts, entries, size = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for block in _blocks(batches):
            x = _matrix(block.column("vector"), parts * size).reshape(-1, parts, size)
            for p in range(parts):
                found = orchard(x[:, p], books[p])[0]
                counts[p] += np.bincount(found, minlength=entries)
                np.add.at(sums[p], found, x[:, p])
        if counts.any():
            index = [i.ravel() for i in np.indices(books.shape)]
            columns = [*(pa.array(i, pa.int32()) for i in index), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), size))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "total", "n"])

    return add_up


def _coder(books: np.ndarray, width: int) -> Callable:
    parts, _, size = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _matrix(block.column("vector"), width).reshape(-1, parts, size)
            found, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                found[:, p], gap, _ = orchard(x[:, p], books[p])
                error += gap
            codes = [row.tobytes().hex() for row in found]
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"],
            )

    return code


def fit_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, size of a part) of the table (vec_id, vector), started from its ``entries`` smallest vec_ids.

    Each round assigns every part to its nearest entry and replaces an entry by the floor of
    its parts' means; an entry that nothing came to stays. With fewer vec_ids there are as
    many entries. Of a vec_id with several vectors the first in order is started from.
    """
    if entries > 256:
        raise ValueError("a code holds one byte for each part")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, -(-width // parts))
    start = rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(entries).collect()
    books = np.zeros((len(start), parts * size), dtype=np.int64)
    for book, row in zip(books, start, strict=True):
        book[:len(row["vector"])] = row["vector"]
    books = np.ascontiguousarray(books.reshape(len(start), parts, size).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        sent = rows.select("vector").mapInArrow(tidy(_summer(books)), "part int, entry int, position int, total long, n long")
        moved = sent.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect()
        for m in moved:
            books[m["part"], m["entry"], m["position"]] = m["total"] // m["n"]
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row of ``vectors`` (vec_id long, vector array<long>, label).

    code has two hex digits for each part's entry, error is the sum of the squared
    distances and label_error its sum over all rows with an equal label, null labels
    together. Null vectors are left out; shorter ones are filled with zeros to the longest,
    and that to a multiple of ``parts``. Repeated rows are each coded and counted; a null
    vec_id is coded but starts no entry. Without any vec_id the result is empty. Other
    columns are left out.
    """
    spark = vectors.sparkSession
    rows = written(vectors.filter("vector IS NOT NULL").select("vec_id", "vector", "label"), "vectors")
    books = fit_codebooks(rows, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not books.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(rows.mapInArrow(tidy(_coder(books, parts * books.shape[2])), schema), "codes")
    discard(rows)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"),
    )
