"""Words of UTF-8 texts as 64-bit hashes, found for a whole Arrow batch at once.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash
takes in eight bytes at a time, each block mixed with what came before; words of more than
LONG_WORD bytes are hashed by BLAKE2b. Nothing is kept between calls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from baitline.functions.shipping import ship_with_tasks

ship_with_tasks(__name__)

#: Texts are worked on in runs of about so many bytes; one longer text makes a run of its own.
RUN_BYTES = 1 << 18
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between each start and end."""
    size = end - start
    out = mix(size.astype(np.uint64) + _STEP)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left, at, rows = size, start, np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(rows):
        rest = np.minimum(left[rows] - done, 8).astype(np.uint64)
        block = eight[at[rows] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
        out[rows] = mix((out[rows] ^ mix(block + _STEP)) * _STEP)
        done += 8
        rows = rows[left[rows] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def equal_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each start in ``data`` are those from its start in ``other``."""
    out = np.ones(len(start), dtype=bool)
    blocks = [np.ndarray((len(d) + 1,), dtype="<u8", buffer=np.concatenate([d, np.zeros(8, np.uint8)]), strides=(1,)) for d in (data, other)]
    rows, done = np.flatnonzero(size <= LONG_WORD), 0
    rows = rows[size[rows] > 0]
    while len(rows):
        rest = np.minimum(size[rows] - done, 8).astype(np.uint64)
        differs = blocks[0][start[rows] + done] ^ blocks[1][other_start[rows] + done]
        out[rows] &= (differs & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))) == 0
        done += 8
        rows = rows[(size[rows] > done) & out[rows]]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = np.array_equal(data[start[i]:start[i] + size[i]], other[other_start[i]:other_start[i] + size[i]])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets into them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, body = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body else np.empty(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


@dataclass
class Words:
    """Words of consecutive texts: ``hashes`` in order, ``first[i]`` to ``first[i + 1]`` belong to text ``row + i``."""

    row: int
    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text within the run."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def parts(self, words: int, beyond: int = 0) -> Iterator[tuple[Words, int]]:
        """The run in parts of so many words, with up to ``beyond`` words that follow, and how many of a part are its own.

        Texts keep their places; those that a part has no words of are empty in it.
        """
        n = len(self.hashes)
        for low in range(0, max(n, 1), words):
            high = min(n, low + words + beyond)
            part = Words(
                self.row, self.hashes[low:high], np.clip(self.first - low, 0, high - low), self.data, self.starts[low:high], self.ends[low:high],
            )
            yield part, min(words, n - low)


def _words(data: np.ndarray, offsets: np.ndarray, row: int, lower: bool, breaks: np.ndarray) -> Words:
    n = len(data)
    body = _LOWER[data] if lower else data
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(breaks[body], out=inside[1:-1])
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts[cuts] = inside[cuts + 1]
    ends[cuts - 1] = inside[cuts]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = hash_spans(body, start, end)
    return Words(row, hashes, np.searchsorted(start, offsets), body, start, end)


def runs(texts: pa.Array, lower: bool = True, run_bytes: int = RUN_BYTES, breaks: np.ndarray = WHITE_SPACE) -> Iterator[Words]:
    """The words of all texts, run by run; ``breaks`` marks the bytes between words, after A-Z are lower-cased if ``lower`` is set."""
    data, offsets = buffers(texts)
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + run_bytes, side="right")) - 1)
        at = offsets[row:stop + 1]
        yield _words(data[at[0]:at[-1]], at - at[0], row, lower, breaks)
        row = stop
