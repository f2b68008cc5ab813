"""Cross-entropy difference of documents under two matched n-gram models.

The target model is counted on texts the caller marks (good ones), the background model
on all texts. Both are interpolated bigram models over the same words and word pairs, told
apart by their full 64-bit hashes; the background's counts are scaled to the target's
mass, so smoothing weighs the same in both. A document's score is its mean loss per token
under the target minus that under the background: the lower, the more the text is like
the target.

Texts are laid into chunks. A chunk sends each of its distinct words and pairs once, with
its counts, to the part of the hash range that they fall in; a part adds up what all
chunks sent and returns the totals to each, in the order they came in. So the tables grow
with the corpus while a task holds one chunk or one part, a word or pair reaches its part
at most once a chunk however frequent it is, and the driver gets one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import bounded_batches, written
from baitline.llm.words import mix, runs
from baitline.llm.worker import release, tidy

ship_with_tasks(__name__)

#: The uniform part spreads over so many words, or over the corpus's distinct words where it has more.
VOCABULARY = 1 << 16
#: Values of the hash that tells pairs apart.
PAIRS = 1 << 64
#: Pseudo-counts of the unigram backing off to the uniform and of the bigram backing off to the unigram.
UNIGRAM_PRIOR, BIGRAM_PRIOR = 0.1, 4.0
_PAIR_FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Stands before the first word of a text.
_START = np.uint64(0x9E6C63D0676A9A99)
#: Text bytes of a chunk; there is a part for every so many bytes of the corpus.
CHUNK_BYTES = 16 << 20
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column(1).fill_null("")
        packed = [packer.compress(t.as_buffer()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _chunker(chunk_bytes: int):
    names = ["chunk", "doc_ids", "targets", "lengths", "packed"]
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def row(ids: list, marks: list, texts: list) -> pa.RecordBatch:
            values = (uuid.uuid4().hex, ids, marks, [len(t) for t in texts], packer.compress(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        ids, marks, texts, held = [], [], [], 0
        for batch in batches:
            for doc_id, packed, mark in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "target")), strict=True):
                text = unpacker.decompress(packed)
                if texts and held + len(text) > chunk_bytes:
                    yield row(ids, marks, texts)
                    ids, marks, texts, held = [], [], [], 0
                ids.append(doc_id)
                marks.append(bool(mark))
                texts.append(text)
                held += len(text)
        if texts:
            yield row(ids, marks, texts)

    return chunk


def _squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _expand(packed: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(dtype).ravel()


class Grams:
    """The words and pairs of a chunk's texts, each distinct one once and in the order of its hash."""

    def __init__(self, lengths: list[int], packed: bytes):
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(packed)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
        texts = pa.Array.from_buffers(pa.large_utf8(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])
        hashes, counts = [], []
        for run in runs(texts):
            hashes.append(run.hashes)
            counts.append(run.counts)
        word = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.counts = np.concatenate([*counts, np.empty(0, np.int64)])
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        first = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        before = np.roll(word, 1)
        before[first] = _START
        # the start is a word of its own, as a history only
        self.words = np.unique(np.append(word, _START))
        self.word, self.before = (np.searchsorted(self.words, x) for x in (word, before))
        self.pairs, at, self.pair = np.unique(mix(mix(before) * _PAIR_FACTOR + word), return_index=True, return_inverse=True)
        self.pair_word, self.pair_before = self.word[at], self.before[at]

    def tables(self, marks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts (all, marked texts) of the words, then of the words as histories; and of the pairs."""
        kept = marks[self.text_of]
        count = lambda x, n: [np.bincount(x, minlength=n), np.bincount(x[kept], minlength=n)]
        n = len(self.words)
        return count(self.word, n) + count(self.before, n), count(self.pair, len(self.pairs))


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal parts of the hash range begins in ascending keys, and the end."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))


def _sender(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, marks, lengths, packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "targets", "lengths", "packed")), strict=True):
                grams = Grams(lengths, packed)
                word_counts, pair_counts = grams.tables(np.array(marks, dtype=bool))
                cuts = [_cuts(grams.words, parts), _cuts(grams.pairs, parts)]
                rows = []
                for p in range(parts):
                    blocks = []
                    for keys, counts, cut in zip((grams.words, grams.pairs), (word_counts, pair_counts), cuts, strict=True):
                        at = slice(cut[p], cut[p + 1])
                        blocks += [_squeeze(np.diff(keys[at], prepend=np.uint64(0))), _squeeze(np.concatenate([c[at] for c in counts]))]
                    rows.append((chunk, p, *blocks))
                columns = zip(*rows, strict=True)
                types = [pa.string(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "part", "words", "word_n", "pairs", "pair_n"],
                )

    return send


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their summed counts, and those sums for the keys of each sender."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((len(counts[0]), len(distinct)), dtype=np.int64)
    for row, column in zip(sums, zip(*counts, strict=True), strict=True):
        np.add.at(row, place, np.concatenate(column))
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return distinct, sums, [sums[:, at] for at in np.split(place, ends)]


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    out = {"chunk": rows["chunk"], "part": rows["part"]}
    sums = {}
    for kind, n in (("word", 4), ("pair", 2)):
        keys = [np.cumsum(_expand(x, np.uint64), dtype=np.uint64) for x in rows[f"{kind}s"]]
        counts = [_expand(x, np.int64).reshape(n, -1) for x in rows[f"{kind}_n"]]
        distinct, total, back = _totals(keys, counts)
        sums[kind] = (distinct, total)
        out[f"{kind}_n"] = [_squeeze(x.ravel()) for x in back]
    distinct, total = sums["word"]
    # figures of the whole part stand in its first row
    for name, figure in (("n_words", (distinct != _START).sum()), ("n_all", total[0].sum()), ("n_target", total[1].sum())):
        out[name] = [int(figure)] + [0] * (len(rows) - 1)
    release()
    return pd.DataFrame(out)


def _scorer(n_words: int, n_all: int, n_target: int):
    uniform = UNIGRAM_PRIOR * max(VOCABULARY, n_words)

    def score(chunks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        out = []
        totals = totals.sort_values("part")
        counted = [np.concatenate([_expand(x, np.int64).reshape(n, -1) for x in totals[f"{kind}_n"]], axis=1) for kind, n in (("word", 4), ("pair", 2))]
        for row in chunks.itertuples():
            grams = Grams(list(row.lengths), row.packed)
            means = []
            for model, mass in ((1, n_target), (0, n_all)):
                scale = n_target / max(mass, 1)
                word, history, pair = (x * scale for x in (counted[0][model], counted[0][2 + model], counted[1][model]))
                unigram = (word + UNIGRAM_PRIOR) / (n_target + uniform)
                p = (pair + BIGRAM_PRIOR * unigram[grams.pair_word]) / (history[grams.pair_before] + BIGRAM_PRIOR)
                sums = np.bincount(grams.text_of, weights=-np.log(p)[grams.pair], minlength=len(grams.counts))
                means.append(sums / np.maximum(grams.counts, 1))
            ids = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64")
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": grams.counts, "target_loss": means[0], "background_loss": means[1], "score": means[0] - means[1]}))
        release()
        return pd.concat(out)

    return score


def score(texts: DataFrame, good: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of (doc_id, text).

    The target are texts whose doc_id is in ``good`` (good_id, distinct); all rows are the
    background. Losses are nats per token. A text without words, or a null one, has no
    tokens and 0.0 in all three; a null doc_id stays null; repeated rows are each counted
    and scored; other columns are left out.
    """
    bounded_batches(texts.sparkSession)
    packed = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_pack), "doc_id long, packed binary")
    # labels grow with the corpus: both sides are always shuffled, so every size runs the same plan
    marked = packed.hint("merge").join(good, F.col("doc_id") == F.col("good_id"), "left")
    chunks = written(
        marked.select("doc_id", "packed", F.col("good_id").isNotNull().alias("target")).mapInArrow(
            tidy(_chunker(chunk_bytes)), "chunk string, doc_ids array<long>, targets array<boolean>, lengths array<long>, packed binary",
        ), "chunks",
    )
    size = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-size // chunk_bytes))
    sent = chunks.mapInArrow(tidy(_sender(parts)), "chunk string, part long, words binary, word_n binary, pairs binary, pair_n binary")
    totals = written(
        sent.groupBy("part").applyInPandas(_add_up, "chunk string, part long, word_n binary, pair_n binary, n_words long, n_all long, n_target long"), "totals",
    )
    figures = [x or 0 for x in totals.agg(F.sum("n_words"), F.sum("n_all"), F.sum("n_target")).first()]
    back = totals.select("chunk", "part", "word_n", "pair_n")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(_scorer(*figures), SCORES)


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept from every fit: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents; the target are those labelled quality 1 whose label is not held out.

    A document with several labels counts as good if one of them is 1. Without any
    target text the target model is uniform. Adds ``held_out`` to the columns of ``score``.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    return score(docs, good.filter(~held_out("good_id"))).withColumn("held_out", held_out())
