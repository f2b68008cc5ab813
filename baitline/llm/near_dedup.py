"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct word shingles as 64-bit hashes; its sketch keeps the
smallest ones. Documents with equal sets are merged first. Inverted lists over runs of
retained values bring documents together, the sketch of the union estimates similarity
and filters, and the full sets, made again from the texts, decide.

Lists of any length are first linked as stars: every member with the smallest. Members
that this puts into one component need no further look. In lists that still hold several
components, all pairs across them are compared: written out for short lists, in blocks
inside tasks for long ones, where the task estimates and verifies and only the links that
hold components together leave it.

Sets under ``SMALL_SET`` values use single values of an exact prefix filter as list keys,
larger ones runs of ``RUN`` neighbouring values of the sketch. Two large sets at the
threshold share no run of three among 48 values with a chance of about 3 in 10**8, and
the estimate drops them with about as much again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.components import components
from baitline.llm.tables import bounded_batches, written
from baitline.llm.words import mix, runs
from baitline.llm.worker import tidy

ship_with_tasks(__name__)

SKETCH, RUN = 48, 3
SMALL_SET = 64
#: Estimates this far below the threshold are dropped. Large sets at 80 % keep 22 of 48 values; fewer have a chance of 3.4e-8.
ESTIMATE_SLACK = 0.35
#: Longer lists are compared in blocks of so many members.
SHORT_LIST, BLOCK, PART, COLUMNS = 48, 1024, 128, 8192
#: Words whose shingles are made together, and bytes of texts that a task unpacks at a time.
SLICE_WORDS, UNPACKED_BYTES = 1 << 18, 4 << 20
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class Rule:
    """Words to a shingle, and the least similarity of linked documents in percent."""

    words: int = 5
    percent: int = 80


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one, no words none."""
    for run in runs(texts):
        found: list[list[np.ndarray]] = [[] for _ in run.counts]
        for part, own in run.parts(SLICE_WORDS, beyond=words - 1):
            n = max(len(part.hashes) - words + 1, 0)
            grams = np.zeros(n, dtype=np.uint64)
            for k in range(words if n else 0):
                grams = mix(grams + part.hashes[k:k + n] * _FACTORS[k % len(_FACTORS)])
            for i in np.flatnonzero(part.counts >= words).tolist():
                low, high = int(part.first[i]), min(int(part.first[i + 1]) - words + 1, own)
                if high > low:
                    found[i].append(np.unique(grams[low:high]))
        for (a, b), parts in zip(zip(run.first[:-1].tolist(), run.first[1:].tolist(), strict=True), found, strict=True):
            if b - a >= words:
                yield parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            elif b > a:
                whole = np.uint64(b - a)
                for value in run.hashes[a:b]:
                    whole = mix(np.array([whole]) * _FACTORS[0] + value)[0]
                yield np.array([whole], dtype=np.uint64)
            else:
                yield np.empty(0, dtype=np.uint64)


def _sketcher(words: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, lows = [], [], []
            for values in shingle_sets(batch.column(1), words):
                sizes.append(len(values))
                marks.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                lows.append(values[:SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(lows, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sketch"],
            )

    return sketch


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(_sketcher(words)), "doc_id long, n_shingles long, set_id binary, sketch binary")


def list_keys(values: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Keys of the inverted lists that a sketch is entered in."""
    keys = []
    if size * percent < SMALL_SET * 100:
        keys.append(mix(values[:size - -(-size * percent // 100) + 1] + np.uint64(1)))
    if size >= SMALL_SET:
        total = np.zeros(len(values) - RUN + 1, dtype=np.uint64)
        for k in range(RUN):
            total = mix(total + values[k:len(values) - RUN + 1 + k] * _FACTORS[k])
        keys.append(total)
    return np.unique(np.concatenate(keys)).view(np.int64)


def _lister(percent: int) -> Callable:
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                list_keys(np.frombuffer(s, np.uint64), n, percent)
                for s, n in zip(batch.column("sketch").to_pylist(), batch.column("n_shingles").to_pylist(), strict=True)
            ]
            reps = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)), pa.array(reps, pa.int64())], names=["list", "rep"],
            )

    return enter


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the union's smallest values that both sketches hold; exact where both sets are retained whole."""
    both = np.sort(np.concatenate([a, b]))
    shared = both[1:] == both[:-1]
    distinct = np.concatenate([both[:1], both[1:][~shared]])
    whole = len(a) < SKETCH and len(b) < SKETCH
    last = distinct[-1] if whole or len(distinct) <= SKETCH else distinct[SKETCH - 1]
    return float((both[1:][shared] <= last).sum() / max(1, (distinct <= last).sum()))


def _estimator(percent: int) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")])
            fits = sizes.min(axis=0) * 100 >= percent * sizes.max(axis=0)
            good = [
                bool(f) and union_estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= percent / 100 - ESTIMATE_SLACK
                for f, x, y in zip(fits, a, b, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return keep


def estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and union sketches allow the similarity."""
    for side in ("a", "b"):
        part = sets.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(part, side)
    return pairs.mapInArrow(tidy(_estimator(percent)), "a long, b long")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress(t.as_buffer()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _packed_sets(packed: Iterable[bytes], words: int) -> Iterator[np.ndarray]:
    """Shingle sets of packed texts, of which few are unpacked at a time."""
    import zstandard

    unpacker, texts, held = zstandard.ZstdDecompressor(), [], 0
    for p in packed:
        texts.append(unpacker.decompress(p))
        held += len(texts[-1])
        if held > UNPACKED_BYTES:
            yield from shingle_sets(pa.array(texts, pa.binary()).cast(pa.string()), words)
            texts, held = [], 0
    yield from shingle_sets(pa.array(texts, pa.binary()).cast(pa.string()), words)


def _parcels(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring rows of at most so many bytes; one larger row is a parcel of its own."""
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if i > low and held + size > most:
            yield slice(low, i)
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield slice(low, len(sizes))


def _unpacked_sizes(packed: Iterable[bytes]) -> list[int]:
    import zstandard

    return [zstandard.frame_content_size(p) for p in packed]


def _verifier(rule: Rule) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("packed_a", "packed_b")]
            good = []
            for rows in _parcels(list(map(sum, zip(*map(_unpacked_sizes, columns), strict=True))), UNPACKED_BYTES):
                pairs = list(zip(columns[0][rows], columns[1][rows], strict=True))
                distinct = list(dict.fromkeys(p for pair in pairs for p in pair))
                sets = dict(zip(distinct, _packed_sets(distinct, rule.words), strict=True))
                for x, y in pairs:
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    good.append(100 * common >= rule.percent * (len(sets[x]) + len(sets[y]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("packed").alias(f"packed_{side}")), side)
    return pairs.mapInArrow(tidy(_verifier(rule)), "a long, b long")


def _short_pairs(members: DataFrame) -> DataFrame:
    """Pairs across components of every short list (list, rep, component)."""
    grouped = members.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("rep", "component"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (y["rep"] > x["rep"]) & (y["component"] != x["component"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")),
    )))
    return grouped.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _incidence(rows: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """1 where a row holds a value; ``values`` must ascend."""
    out = np.zeros((len(rows), len(values)), dtype=np.float32)
    if len(values):
        for k, row in enumerate(rows):
            place = np.minimum(np.searchsorted(values, row), len(values) - 1)
            out[k, place[values[place] == row]] = 1
    return out


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    values = np.intersect1d(np.concatenate([*left, np.empty(0, np.uint64)]), np.concatenate([*right, np.empty(0, np.uint64)]))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for i in range(0, len(values), COLUMNS):
        part = values[i:i + COLUMNS]
        cut = [[row[np.searchsorted(row, part[0]):np.searchsorted(row, part[-1], side="right")] for row in side] for side in (left, right)]
        out += _incidence(cut[0], part) @ _incidence(cut[1], part).T
    return out


def _block_linker(rule: Rule) -> Callable:
    """Verified links across components between two blocks of one list, as many as hold their components together."""

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        right = right if len(right) else left
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        numbers = lambda part, column: [np.frombuffer(x, np.uint64) for x in part[column]]
        earlier = lambda part: [np.sort(np.array([k for k in x if k < key[0]], np.int64).astype(np.uint64)) for x in part["lists"]]
        sizes_r, comps_r, reps_r = (right[c].to_numpy() for c in ("n_shingles", "component", "rep"))
        sketches_r, earlier_r, packed_r = numbers(right, "sketch"), earlier(right), right["packed"].tolist()
        bytes_l, bytes_r = _unpacked_sizes(left["packed"]), _unpacked_sizes(packed_r)
        # the right side's sets are kept where all fit the budget, else made again for each part of the left
        kept = sum(bytes_r) <= 4 * UNPACKED_BYTES
        sets_r: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for at in (slice(i + p.start, i + p.stop) for i in range(0, len(left), PART) for p in _parcels(bytes_l[i:i + PART], UNPACKED_BYTES)):
            part = left.iloc[at]
            sizes, comps, reps = (part[c].to_numpy()[:, None] for c in ("n_shingles", "component", "rep"))
            least = np.minimum(sizes, sizes_r)
            fits = (comps != comps_r) & (reps != reps_r) & (least * 100 >= rule.percent * np.maximum(sizes, sizes_r))
            # what both sketches hold is at least what counts in the union's sketch
            fits &= common_counts(numbers(part, "sketch"), sketches_r) >= np.minimum(least, SKETCH) * (rule.percent / 100 - ESTIMATE_SLACK)
            # a pair belongs to the first long list that both are in
            fits &= common_counts(earlier(part), earlier_r) == 0
            if not fits.any():
                continue
            some = np.flatnonzero(fits.any(axis=1))
            sets_l = list(_packed_sets(part["packed"].iloc[some], rule.words))
            wanted = np.flatnonzero(fits.any(axis=0))
            for rows_r in _parcels([bytes_r[j] for j in wanted], UNPACKED_BYTES):
                own = wanted[rows_r].tolist()
                missing = [j for j in own if j not in sets_r]
                made = dict(zip(missing, _packed_sets([packed_r[j] for j in missing], rule.words), strict=True))
                common = common_counts(sets_l, [sets_r[j] if j in sets_r else made[j] for j in own])
                here = np.ix_(some, own)
                fits[here] &= 100 * common >= rule.percent * ((sizes + sizes_r)[here] - common)
                if kept:
                    sets_r.update(made)
            for k in np.flatnonzero(fits.any(axis=1)):
                own = find(int(comps[k, 0]))
                near, first = np.unique(comps_r[fits[k]], return_index=True)
                for component, j in zip(near.tolist(), reps_r[fits[k]][first].tolist(), strict=True):
                    other = find(component)
                    if other != own:
                        root[other] = own
                        found.append((int(reps[k, 0]), j))
        return pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return link


def _long_links(members: DataFrame, sets: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Verified links across components of long lists (list, rep, n, component); every pair of blocks is one group.

    Sketches, texts and the other long lists of a member (at most as many as its sketch
    has keys) come along, so a task estimates, verifies and sends only a spanning forest.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side"),
    ))
    lists = members.groupBy("rep").agg(F.collect_set("list").alias("lists"))
    known = lists.join(sets.select("rep", "n_shingles", "sketch"), "rep").join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id")
    rows = placed.select("list", "rep", "component", F.explode(meetings).alias("m")).select("list", "rep", "component", "m.i", "m.j", "m.side")
    return rows.join(known, "rep").groupBy("list", "i", "j").applyInPandas(_block_linker(rule), "a long, b long")


def links_between_sets(docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Verified links (a, b) between documents that stand for distinct sets, enough to hold every component together.

    ``sets`` has (rep, n_shingles, sketch). A link is left out only where the same
    component is already held together by others.
    """
    entered = sets.mapInArrow(tidy(_lister(rule.percent)), "list long, rep long")
    sizes = entered.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    members = written(entered.join(sizes, "list"), "lists")
    wanted = members.select("rep").distinct()
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    packed = packed.mapInArrow(tidy(_pack), "doc_id long, packed binary")
    texts = written(packed.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").distinct(), "texts")
    stars = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    first = written(verified(estimated(stars, sets, rule.percent), texts, rule), "links")
    joined = components(first)
    named = members.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_lists = written(named.join(mixed.select("list"), "list").select("list", "rep", "n", "component"), "open-lists")
    short = verified(estimated(_short_pairs(open_lists.filter(F.col("n") <= SHORT_LIST)), sets, rule.percent), texts, rule)
    long = _long_links(open_lists.filter(F.col("n") > SHORT_LIST), sets, texts, rule)
    return first.unionByName(written(short.unionByName(long), "links"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row for every row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows that share a doc_id are one document with all their texts. Equal sets are linked,
    however many; texts without words (null ones too) are linked with nothing. component_id
    is the smallest doc_id reachable over links, itself included; kept marks the row that
    bears it. A null doc_id is linked with nothing and kept, with a null component_id.
    Other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = written(sketches(docs, rule.words), "sketches")
    usable = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = written(
        usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")),
        "sets",
    )
    links = links_between_sets(docs, sets, rule)
    several = usable.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).filter("low <> high")
    same = usable.join(several.select("doc_id"), "doc_id", "left_semi").join(sets.select("set_id", "rep"), "set_id")
    found = components(links.unionByName(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    named = sets.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("set_id").alias("of"), F.coalesce("component", "rep").alias("component"),
    )
    linked = rows.join(named, F.col("set_id") == F.col("of"), "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return linked.withColumn("kept", F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_copies(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, with all their columns.

    Repeats of a staying row (equal doc_id and text) go too; rows with a null doc_id stay.
    """
    stay = near_duplicates(docs, rule).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
