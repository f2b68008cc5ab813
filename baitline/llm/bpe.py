"""BPE encoding and decoding with content-defined chunk reuse.

Texts are kept once by digest and cut where a rolling hash of their bytes says so, so
texts that share passages share chunks. The part of a chunk between its first and last
white space is its core: no token of this kind of vocabulary spans white space, so a
core's ids are the same wherever it occurs. A core that occurs more than once is encoded
by one owner and its ids are joined to all places; other cores are encoded where they
are. What lies between two cores (a seam) is widened to the white space on both sides,
where encodings of the parts and of the whole agree exactly, and re-encoded there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baitline.functions.shipping import ship_with_tasks
from baitline.llm.tables import bounded_batches
from baitline.llm.words import RUN_BYTES, Words, buffers, equal_spans, mix, runs
from baitline.llm.worker import tidy

ship_with_tasks(__name__)

WINDOW, LEAST_CHUNK, MEAN_CHUNK_BITS = 32, 256, 10
#: White space at which every supported tokenizer ends a token.
GAPS = b" \t\n\r\x0b\x0c"
_GAP = re.compile(b"[ \t\n\r\x0b\x0c]")
#: Words whose ids a task remembers; when there are more, it starts over.
REMEMBERED_WORDS = 200_000
#: Texts are encoded in runs of about so many bytes.
ENCODED_BYTES = 1_000_000
#: New words that one call to the tokenizer takes.
LEARNED_WORDS = 10_000
#: A word of its own that marks the ends of words encoded in one call.
MARK = "\x01"
BATCH_BYTES = 2 << 20
_ROLL = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))


class WordCoder:
    """Ids of words, remembered, from a tokenizer file. Words are found and looked up by hash, a run of texts at a time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.pieces = [n.encode() for n in names]
        self.closing = np.array([n.endswith("</w>") for n in names])
        self.mark = self._ids(MARK)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.spelled, self.letters = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _learned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has, from as few calls as can be told apart again."""
        if all(t.isalpha() for t in texts):
            # a word of letters ends in one closing piece; if letters fall apart when normalised there are more
            ids = self._ids(" ".join(texts))
            at = np.flatnonzero(self.closing[ids]) + 1
            if len(at) == len(texts):
                return ids, np.diff(at, prepend=0)
        elif len(self.mark) == 1 and not any(MARK in t or "<|" in t for t in texts):
            ids = self._ids(f" {MARK} ".join(texts))
            marks = ids == self.mark[0]
            at = np.flatnonzero(marks)
            if len(at) == len(texts) - 1:
                return ids[~marks], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for ids in found for x in ids], dtype=np.uint32), np.array([len(x) for x in found])

    def _learn(self, words: list[bytes], hashes: list[int]) -> np.ndarray:
        """Remember new words; returns their places."""
        groups: list[list[int]] = [[], [], []]
        texts = [w.decode() for w in words]
        for i, t in enumerate(texts):
            groups[0 if t.isalpha() else 2 if "<|" in t or MARK in t else 1].append(i)
        places, done = np.empty(len(words), np.int64), len(self.first) - 1
        flat, sizes, lengths, spelled = [self.flat], [], [], [self.spelled]
        for group in groups:
            for k in range(0, len(group), LEARNED_WORDS):
                part = group[k:k + LEARNED_WORDS]
                ids, size = self._learned([texts[i] for i in part])
                flat.append(ids)
                sizes.append(size)
                lengths.append([len(words[i]) for i in part])
                spelled.append(np.frombuffer(b"".join([words[i] for i in part]), np.uint8))
                places[part] = np.arange(done, done + len(part))
                done += len(part)
        self.known.update(zip(hashes, places.tolist(), strict=False))
        upto = lambda old, new: np.concatenate([old, old[-1] + np.cumsum(np.concatenate(new))])
        self.flat, self.first = np.concatenate(flat), upto(self.first, sizes)
        self.spelled, self.letters = np.concatenate(spelled), upto(self.letters, lengths)
        return places

    def _unlike(self, run: Words, place: np.ndarray) -> np.ndarray:
        """Words of a run whose bytes are not those remembered at their places: hashes can collide."""
        size = run.ends - run.starts
        like = self.letters[place + 1] - self.letters[place] == size
        rows = np.flatnonzero(like)
        like[rows] = equal_spans(run.data, run.starts[rows], self.spelled, self.letters[place[rows]], size[rows])
        return np.flatnonzero(~like)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        for run in runs(pa.array(texts, pa.binary()).cast(pa.string()), lower=False, run_bytes=ENCODED_BYTES):
            if len(self.known) > REMEMBERED_WORDS:
                self._forget()
            hashes, at, of = np.unique(run.hashes, return_index=True, return_inverse=True)
            start, end = run.starts[at], run.ends[at]
            listed, body = hashes.tolist(), run.data.tobytes()
            place = np.array([self.known.get(h, -1) for h in listed], dtype=np.int64)
            new = np.flatnonzero(place < 0)
            if len(new):
                fresh = [body[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
                place[new] = self._learn(fresh, [listed[i] for i in new.tolist()])
            place = place[of.reshape(-1)]
            odd = self._unlike(run, place).tolist()
            if odd:
                spelled = [body[run.starts[i]:run.ends[i]] for i in odd]
                own = dict.fromkeys(spelled)
                own = dict(zip(own, self._learn(list(own), []).tolist(), strict=True))
                place[odd] = [own[w] for w in spelled]
            size = self.first[place + 1] - self.first[place]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(self.first[place] - upto[:-1], size) + np.arange(upto[-1])]
            bounds = upto[run.first]
            out += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.pieces.__getitem__, ids.tolist()))


def cut_points(texts: pa.Array) -> Iterator[list[int]]:
    """For each text the byte offsets between its chunks, 0 and the length included."""
    data, offsets = buffers(texts)
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, side="right")) - 1)
        at = offsets[row:stop + 1] - offsets[row]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_ROLL[data[offsets[row]:offsets[stop]]])])
        window = (sums[WINDOW:] - sums[:-WINDOW]) * np.uint64(0x9E3779B97F4A7C15)
        marks = np.flatnonzero(window >> np.uint64(64 - MEAN_CHUNK_BITS) == 0) + WINDOW
        bounds = np.searchsorted(marks, at)
        for i in range(len(at) - 1):
            start, end = int(at[i]), int(at[i + 1])
            cuts = [0]
            for mark in marks[bounds[i]:bounds[i + 1]].tolist():
                if mark - start - cuts[-1] >= LEAST_CHUNK and mark < end:
                    cuts.append(mark - start)
            yield [*cuts, end - start]
        row = stop


def core_spans(text: bytes, cuts: list[int]) -> list[tuple[int, int]]:
    """The part of each chunk from its first to its last white space; empty spans are left out."""
    spans = []
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        first = _GAP.search(text, start, end)
        if first:
            last = max(text.rfind(GAPS[k:k + 1], start, end) for k in range(len(GAPS)))
            if last - first.start() > LEAST_CHUNK // 4:
                spans.append((first.start(), last + 1))
    return spans


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress(t.as_buffer()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["text_key", "packed"])


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their unpacked texts, a few bytes at a time; one longer text is a parcel of its own."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        low, texts, held = 0, [], 0
        for i, packed in enumerate(batch.column("packed")):
            texts.append(unpacker.decompress(packed.as_buffer()))
            held += len(texts[-1])
            if held >= ENCODED_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(low, len(texts)), texts
                low, texts, held = i + 1, [], 0


def _spans_of(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    cuts = cut_points(pa.array(texts, pa.binary()).cast(pa.string()))
    return [core_spans(t, c) for t, c in zip(texts, cuts, strict=True)]


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _parcels(batches):
        keys, places, digests = [], [], []
        for key, text, spans in zip(batch.column("text_key").to_pylist(), texts, _spans_of(texts), strict=True):
            for place, (start, end) in enumerate(spans):
                keys.append(key)
                places.append(place)
                digests.append(_digest(text[start:end]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(digests, pa.binary())], names=["text_key", "place", "core"],
        )


def _publisher(path: str) -> Callable:
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(path)
        for batch, texts in _parcels(batches):
            owned = batch.column("places").to_pylist()
            cores = [t[slice(*spans[p])] for t, spans, own in zip(texts, _spans_of(texts), owned, strict=True) for p in own]
            ids = [x.astype("<u4").tobytes() for x in coder.encode(cores)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(c) for c in cores], pa.binary()), pa.array(ids, pa.binary())], names=["core", "ids"])

    return publish


def _parts(text: bytes, spans: list[tuple[int, int]], known: dict[int, bytes]) -> list[tuple[int, int] | int]:
    """The text in order as places of borrowed cores and byte ranges to encode here."""
    parts: list[tuple[int, int] | int] = []
    done = 0
    for place, (start, end) in enumerate(spans):
        if place in known:
            if start > done:
                parts.append((done, start))
            parts.append(place)
            done = end
    return [*parts, (done, len(text))] if done < len(text) else parts


def _assembler(path: str) -> Callable:
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(path)
        for batch, texts in _parcels(batches):
            borrowed = [{b["place"]: b["ids"] for b in row or ()} for row in batch.column("borrowed").to_pylist()]
            spans = iter(_spans_of([t for t, known in zip(texts, borrowed, strict=True) if known]))
            plans = [_parts(t, next(spans), known) if known else [(0, len(t))] for t, known in zip(texts, borrowed, strict=True)]
            encoded = iter(coder.encode([t[slice(*p)] for t, plan in zip(texts, plans, strict=True) for p in plan if isinstance(p, tuple)]))
            keys, ids, decoded, held = [], [], [], 0
            for key, plan, known in zip(batch.column("text_key").to_pylist(), plans, borrowed, strict=True):
                parts = [np.frombuffer(known[p], "<u4") if isinstance(p, int) else next(encoded) for p in plan]
                whole = np.concatenate(parts) if parts else np.empty(0, np.uint32)
                keys.append(key)
                ids.append(whole.astype("<u4").tobytes())
                decoded.append(coder.decode(whole))
                held += len(ids[-1]) + len(decoded[-1])
                if held > BATCH_BYTES:
                    yield _encoded(keys, ids, decoded)
                    keys, ids, decoded, held = [], [], [], 0
            yield _encoded(keys, ids, decoded)

    return assemble


def _encoded(keys: list[bytes], ids: list[bytes], decoded: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (keys, ids, decoded)], names=["text_key", "ids", "decoded"])


def _schema(**columns: T.DataType) -> T.StructType:
    """Columns that are never null: joins then add no null filter, and the shuffle of the texts is run once for all its readers."""
    return T.StructType([T.StructField(name, kind, nullable=False) for name, kind in columns.items()])


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; a null text has the key of the empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(text_key, ids, decoded) of every distinct text of ``docs``: ids as little-endian unsigned 32-bit integers, decoded UTF-8.

    ``tokenizer`` is a tokenizers file that every executor can read, with a vocabulary
    whose tokens never span white space and which drops it, decoded by joining tokens with
    spaces. Empty texts have no ids. A text must fit a task; nothing else must.
    """
    bounded_batches(docs.sparkSession)
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(text_key(F.col("text")).alias("text_key"), body.alias("text"))
    packed = rows.mapInArrow(tidy(_pack), _schema(text_key=T.BinaryType(), packed=T.BinaryType())).groupBy("text_key").agg(F.first("packed").alias("packed"))
    cores = packed.mapInArrow(tidy(_cores), _schema(text_key=T.BinaryType(), place=T.IntegerType(), core=T.BinaryType()))
    shared = cores.groupBy("core").agg(
        F.min(F.struct("text_key", "place")).alias("owner"), F.count(F.lit(1)).alias("n"),
    ).filter("n > 1")
    owners = shared.groupBy(F.col("owner.text_key").alias("text_key")).agg(F.collect_list("owner.place").alias("places"))
    published = packed.join(owners, "text_key").mapInArrow(tidy(_publisher(tokenizer)), "core binary, ids binary")
    borrowed = cores.join(published, "core").groupBy("text_key").agg(
        F.collect_list(F.struct("place", "ids")).alias("borrowed"),
    )
    return packed.join(borrowed, "text_key", "left").mapInArrow(tidy(_assembler(tokenizer)), "text_key binary, ids binary, decoded binary")


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in which equal texts share one encoding."""
    digests = encode_texts(docs, tokenizer).select(
        "text_key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key")).join(digests, "text_key").drop("text_key")
