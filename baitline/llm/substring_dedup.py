"""Removing passages that an earlier document already has, by suffix automata.

Fingerprints find where the corpus can repeat at all. Every window of so many words has an
anchor, the smallest hash among its runs of ``GRAM`` words, so equal windows share it.
Runs of neighbouring windows with one anchor that several texts have are cut out as
segments, and equal segments of any number of documents become one, with its smallest and
largest doc_id. Of windows that segments share, the segment of the smallest doc_id is the
home.

Home segments are the reference. They are dealt into shards of bounded size, a suffix
automaton is built over the words of each, and its states know the smallest document they
occur in. The automaton of a shard goes to as many blocks as the segments that may repeat
its content need; there they are streamed through it, and the matching statistics say
which windows occur, and first in which document. That decides: fingerprints only route.
A document loses every word of a window that a smaller document has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import bounded_batches, written
from baitline.llm.words import Words, mix, runs
from baitline.llm.worker import release, tidy

ship_with_tasks(__name__)

#: Words of the runs whose smallest hash is a window's anchor; windows must have at least as many.
GRAM = 16
#: Words that are fingerprinted together, so that a very long text is held in parts.
SLICE_WORDS = 1 << 17
#: Home segments of an automaton, and segments streamed through one copy of it.
SHARD_SEGMENTS, BLOCK_SEGMENTS = 1000, 4000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, put together from spans of doubling length."""
    total, done, span, width = None, 0, words, 1
    while True:
        if size & width:
            n = len(words) - size + 1
            part = span[done:done + n]
            total = part if total is None else mix(total * _FACTOR + part)
            done += width
        if done == size:
            return total
        span = mix(span[:-width] * _FACTOR + span[width:])
        width *= 2


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place on."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    from_start = np.minimum.accumulate(blocks, axis=1).ravel()
    to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_end[:n - width + 1], from_start[width - 1:n])


def window_anchors(run: Words, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice, for every window within a text: its text in the run, its first word in the run, its anchor."""
    of = run.text_of()
    for low in range(0, len(of) - window + 1, SLICE_WORDS):
        words, own = run.hashes[low:low + SLICE_WORDS + window - 1], of[low:low + SLICE_WORDS + window - 1]
        inside = np.flatnonzero(own[:len(own) - window + 1] == own[window - 1:])
        if len(inside):
            yield own[inside], low + inside, sliding_minimum(span_hashes(words, GRAM), window - GRAM + 1)[inside]


def _fingerprinter(window: int):
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, wholes, anchors = [], [], []
            for run in runs(batch.column("text"), lower=False):
                n, body = len(run.counts), run.data.tobytes()
                found: list[list[np.ndarray]] = [[] for _ in range(n)]
                for text, _, anchor in window_anchors(run, window):
                    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
                    cuts = np.searchsorted(text[change], np.arange(text[0], text[-1] + 2))
                    for i in range(int(text[0]), int(text[-1]) + 1):
                        found[i].append(anchor[change[cuts[i - text[0]]:cuts[i - text[0] + 1]]])
                sizes += run.counts.tolist()
                anchors += [np.unique(np.concatenate(f)).view(np.int64) if f else np.empty(0, np.int64) for f in found]
                # words joined by one space, their digest
                for a, b in zip(run.first[:-1].tolist(), run.first[1:].tolist(), strict=True):
                    wholes.append(_kept_digest(run, body, np.arange(a, b)))
            rows = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(a) for a in anchors])]), pa.int32()),
                pa.array(np.concatenate([*anchors, np.empty(0, np.int64)]), pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(wholes, pa.string()), rows],
                names=["doc_id", "text_key", "n_words", "whole_sha256", "anchors"],
            )

    return fingerprint


def _kept_digest(run: Words, body: bytes, words: np.ndarray) -> str:
    """SHA-256 of the given words of a run, joined by one space; neighbours one space apart are taken in one piece."""
    digest = hashlib.sha256()
    if len(words):
        starts, ends = run.starts[words], run.ends[words]
        plain = (starts[1:] - ends[:-1] == 1) & (run.data[ends[:-1]] == 32)
        cut = np.flatnonzero(~plain)
        pieces = zip(starts[np.concatenate([[0], cut + 1])].tolist(), ends[np.concatenate([cut, [len(words) - 1]])].tolist(), strict=True)
        for k, (a, b) in enumerate(pieces):
            digest.update(b" " + body[a:b] if k else body[a:b])
    return digest.hexdigest()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([packer.compress(t.as_buffer()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_key"), packed], names=["doc", "text_key", "packed"])


def _parcels(batches: Iterator[pa.RecordBatch], budget: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows with their unpacked texts, of about ``budget`` bytes at a time."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        low, texts, held = 0, [], 0
        for i, packed in enumerate(batch.column("packed")):
            text = unpacker.decompress(packed.as_buffer())
            texts.append(text)
            held += len(text)
            if held >= budget or i + 1 == batch.num_rows:
                yield batch.slice(low, len(texts)), pa.array(texts, pa.binary()).cast(pa.string())
                low, texts, held = i + 1, [], 0


def _cutter(window: int):
    longest = window - GRAM + 1
    names = ["text_key", "doc", "place", "segment", "words"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parcels(batches):
            shared = np.unique(np.concatenate([*(np.array(x, np.int64) for x in batch.column("shared").to_pylist()), np.empty(0, np.int64)]).view(np.uint64))
            keys, docs = batch.column("text_key").to_pylist(), batch.column("doc").to_pylist()
            rows = []
            for run in runs(texts, lower=False):
                body, starts, ends = run.data.tobytes(), run.starts, run.ends
                for text, place, anchor in window_anchors(run, window):
                    at = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
                    wanted = np.flatnonzero(shared[at] == anchor) if len(shared) else np.empty(0, np.int64)
                    if not len(wanted):
                        continue
                    text, place, anchor = text[wanted], place[wanted], anchor[wanted]
                    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1])])
                    begin = np.flatnonzero(new)
                    for i, j in zip(begin.tolist(), np.append(begin[1:], len(text)).tolist(), strict=True):
                        # equal runs of words can give long segments: they are cut
                        for a in range(i, j, longest):
                            n = min(longest, j - a) + window - 1
                            p, t = int(place[a]), run.row + int(text[a])
                            words = b" ".join([body[x:y] for x, y in zip(starts[p:p + n].tolist(), ends[p:p + n].tolist(), strict=True)])
                            rows.append((keys[t], docs[t], p - int(run.first[text[a]]), hashlib.blake2b(words, digest_size=16).digest(), words))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return cut


def _windower(window: int):
    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "low", "high"))
            for run in runs(batch.column("words").cast(pa.string()), lower=False):
                if len(run.hashes) < window:
                    continue
                of, n = run.text_of(), len(run.hashes) - window + 1
                inside = np.flatnonzero(of[:n] == of[window - 1:])
                row = run.row + of[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span_hashes(run.hashes, window)[inside].view(np.int64)), *(pa.array(x[row]) for x in (ids, low, high))],
                    names=["window", "id", "low", "high"],
                )

    return list_windows


class Automaton:
    """A suffix automaton of several sequences of words; states know the smallest document they occur in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.low = [-1], [0], [math.inf]

    def _state(self, size: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.low.append(math.inf)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the shorter sequences that reach it from p."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], doc: int) -> None:
        last, following, size, link = 0, self.next, self.size, self.link
        for word in words:
            q = following[last].get(word)
            if q is not None:
                last = q if size[last] + 1 == size[q] else self._split(last, word, q)
            else:
                p, last = last, self._state(size[last] + 1, {}, 0)
                while p != -1 and word not in following[p]:
                    following[p][word] = last
                    p = link[p]
                if p != -1:
                    q = following[p][word]
                    link[last] = q if size[p] + 1 == size[q] else self._split(p, word, q)
            if doc < self.low[last]:
                self.low[last] = doc

    def finish(self) -> None:
        """Pass smallest documents on to the suffixes of each state."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            above = self.link[state]
            if self.low[state] < self.low[above]:
                self.low[above] = self.low[state]

    def first_documents(self, words: list[int], window: int) -> list[tuple[int, int]]:
        """(place, smallest document) of every window of ``words`` that occurs, from its matching statistics."""
        following, link, size, low = self.next, self.link, self.size, self.low
        state, matched, out = 0, 0, []
        for at, word in enumerate(words, 1):
            while state and word not in following[state]:
                state = link[state]
                matched = size[state]
            state = following[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                while size[link[state]] >= window:
                    state = link[state]
                    matched = size[state]
                out.append((at - window, low[state]))
        return out


def _streamer(window: int):
    def stream(homes: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(homes) and len(segments):
            automaton, number = Automaton(), {}
            for words, doc in zip(homes["content"], homes["doc"].tolist(), strict=True):
                automaton.add([number.setdefault(w, len(number)) for w in words.split()], doc)
            automaton.finish()
            for name, words in zip(segments["id"].tolist(), segments["words"], strict=True):
                found = automaton.first_documents([number.get(w, -1) for w in words.split()], window)
                if found:
                    rows.append((name, [f[0] for f in found], [f[1] for f in found]))
            del automaton
            release()
        return pd.DataFrame(rows, columns=["id", "places", "firsts"])

    return stream


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parcels(batches):
            hits = batch.column("hits").to_pylist()
            kept, digests, bodies = [], [], []
            for run in runs(texts, lower=False):
                body = run.data.tobytes()
                for i, (a, b) in enumerate(zip(run.first[:-1].tolist(), run.first[1:].tolist(), strict=True)):
                    edge = np.zeros(b - a + 1, dtype=np.int64)
                    at = np.array(hits[run.row + i], dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = a + np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    kept.append(len(words))
                    digests.append(_kept_digest(run, body, words))
                    bodies.append(b" ".join([body[x:y] for x, y in zip(run.starts[words].tolist(), run.ends[words].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), pa.array(kept, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary()).cast(pa.string())],
                names=["of", "n_kept", "kept_sha256", "kept_text"],
            )

    return remove


def _text_key(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def first_holders(segments: DataFrame, window: int) -> DataFrame:
    """(id, places, firsts): windows of each segment (id, low, high, words) that documents share, and the smallest document that has them."""
    windows = segments.mapInArrow(tidy(_windower(window)), "window long, id long, low long, high long")
    shared = windows.groupBy(F.col("window").alias("of")).agg(
        F.min("low").alias("first"), F.max("high").alias("last"), F.min_by("id", "low").alias("home"),
    ).filter("first < last")
    routes = written(windows.join(shared, F.col("window") == F.col("of")).select("id", "home").distinct(), "routes")
    n_homes = routes.select("home").distinct().count()
    shards = max(1, math.ceil(n_homes / SHARD_SEGMENTS))
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int")
    asked = written(routes.select("id", shard.alias("shard")).distinct(), "streams")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SEGMENTS).cast("int").alias("blocks"))
    homes = routes.select(F.col("home").alias("id"), shard.alias("shard")).distinct().join(segments.select("id", "low", "words"), "id")
    homes = homes.join(blocks, "shard").select(
        F.col("shard").alias("of_shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_block"), F.col("low").alias("doc"), F.col("words").alias("content"),
    )
    streams = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id")
    streams = streams.join(segments.select("id", "words"), "id")
    return homes.groupBy("of_shard", "of_block").cogroup(streams.groupBy("shard", "block")).applyInPandas(_streamer(window), "id long, places array<int>, firsts array<long>")


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of documents (doc_id, text).

    Words are what white space (0x20, 0x09-0x0D) parts, unchanged. A word goes if a window of
    ``window`` consecutive words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. Rows with one doc_id are one document, each
    text on its own: they take nothing from each other. A null doc_id neither gives nor
    takes. Null and empty texts have no words and stay empty. kept_sha256 is that of the
    kept words joined by one space; kept_text holds them where some, but not all, words
    went, and is null where all of the text stays or none of it does. Other columns are
    left out.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    bounded_batches(docs.sparkSession)
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(body).alias("text_key"), body.alias("text"))
    passed = written(
        rows.mapInArrow(tidy(_fingerprinter(window)), "doc_id long, text_key binary, n_words long, whole_sha256 string, anchors array<long>"), "fingerprints",
    )
    able = passed.filter((F.col("doc_id").isNotNull()) & (F.col("n_words") >= window))
    texts = written(able.groupBy("text_key").agg(F.min("doc_id").alias("doc"), F.first("anchors").alias("anchors")), "texts")
    anchors = texts.select(F.explode("anchors").alias("anchor"), "text_key", "doc")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    listed = anchors.join(shared, "anchor").groupBy("text_key", "doc").agg(F.collect_list("anchor").alias("shared"))
    packed = rows.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text_key", "text").mapInArrow(
        tidy(_pack), "doc long, text_key binary, packed binary",
    )
    able_texts = written(packed.join(listed, ["text_key", "doc"]).dropDuplicates(["text_key", "doc"]), "candidates")
    cut = written(
        able_texts.mapInArrow(tidy(_cutter(window)), "text_key binary, doc long, place long, segment binary, words binary"), "segments",
    )
    distinct = cut.groupBy("segment").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.first("words").alias("words"))
    segments = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-segments")
    found = written(first_holders(segments, window), "matches")
    hits = found.select("id", F.arrays_zip("places", "firsts").alias("hits"))
    answers = segments.select("segment", "id").join(hits, "id")
    own = F.filter("hits", lambda h: h["firsts"] < F.col("doc"))
    removed = cut.select("segment", "text_key", "doc", "place").join(answers, "segment").select(
        "text_key", F.transform(own, lambda h: h["places"] + F.col("place")).alias("places"),
    ).filter(F.size("places") > 0).groupBy("text_key").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("hits"))
    changed = able_texts.select("text_key", "packed").join(removed, "text_key").mapInArrow(
        tidy(_remover(window)), "of binary, n_kept long, kept_sha256 string, kept_text string",
    )
    changed = texts.select("text_key", "doc").join(changed, F.col("text_key") == F.col("of"), "left").select(
        F.col("text_key").alias("of"), "doc", "n_kept", "kept_sha256", "kept_text",
    )
    # a document with the text of a smaller one loses all of it
    copy = F.coalesce(F.col("doc_id") > F.col("doc"), F.lit(False))
    partly = (F.col("doc_id") == F.col("doc")) & F.col("n_kept").isNotNull()
    return passed.select("doc_id", "text_key", "n_words", "whole_sha256").join(changed, F.col("text_key") == F.col("of"), "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(partly, F.col("n_words") - F.col("n_kept")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(partly, F.col("kept_sha256")).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
        F.when(partly & ~copy, F.col("kept_text")).alias("kept_text"),
    )
