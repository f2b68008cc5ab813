"""Orchard's search and vector codes against comparing all entries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitline.llm import vector_codes


@pytest.mark.parametrize("k", [1, 2, 16, 200])
def test_orchard_is_exact_and_looks_at_less(k):
    draw = np.random.default_rng(k)
    centres = draw.integers(-4000, 4000, (k, 8))
    entries = np.concatenate([centres, centres[: k // 2]])
    points = entries[draw.integers(0, len(entries), 3000)] + draw.integers(-60, 60, (3000, 8))
    points[::7] = entries[draw.integers(0, len(entries), len(points[::7]))]
    found, far, looked = vector_codes.orchard(points, entries)
    gap = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == gap.argmin(axis=1)).all() and (far == gap.min(axis=1)).all()
    assert looked <= gap.size and (k < 200 or looked < 0.7 * gap.size)


def brute(rows, parts, k, rounds):
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    size = width // parts
    pad = lambda v: [*v, *[0] * (width - len(v))]
    start = {}
    for i, v, _ in rows:
        if i is not None:
            start[i] = min(start.get(i, v), v)
    books = [[pad(start[i])[p * size:(p + 1) * size] for i in sorted(start)[:k]] for p in range(parts)]
    x = [[pad(v)[p * size:(p + 1) * size] for p in range(parts)] for _, v, _ in rows]
    gap = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b, strict=True))
    nearest = lambda v, book: min((gap(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v[p], books[p])[1] for v in x]
            for e in range(len(books[p])):
                mine = [v[p] for v, o in zip(x, own, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[nearest(v[p], books[p]) for p in range(parts)] for v in x]
    errors = [sum(n[0] for n in row) for row in last]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = lambda label: sum(e for e, r in zip(errors, rows, strict=True) if r[2] == label)
    return sorted(repr((i, "".join(f"{n[1]:02x}" for n in row), e, total(label), digest)) for (i, _, label), row, e in zip(rows, last, errors, strict=True))


def test_codes_against_plain_rounds(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i % 90), draw.integers(-900, 900, 10 if i % 9 else 7).tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(150)]
    rows += [(None, [5] * 10, 1), (0, rows[0][1], None), (3, [], 2), *[(200 + i, [100] * 10, 7) for i in range(60)]]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int").withColumn("code", F.lit(1)).withColumn("error", F.lit(2))
    got = sorted(repr(tuple(r)) for r in vector_codes.compress(frame, 4, 16, 6).collect())
    assert got == brute(rows, 4, 16, 6)


def test_few_rows(spark):
    schema = "vec_id long, vector array<long>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    row = vector_codes.compress(spark.createDataFrame([(9, [1, 2, 3], None)], schema)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in row] == [(9, "00" * 8, 0, 0)]


def test_large_components_are_held(spark):
    frame = spark.createDataFrame([([1e300, -1e300, 0.25, -0.1],)], "v array<double>")
    assert frame.select(vector_codes.whole_components(F.col("v"))).first()[0] == [1 << 27, -(1 << 27), 1024, -410]
