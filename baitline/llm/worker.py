"""What a Python worker does when a task ends."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

from baitline.functions.shipping import ship_with_tasks

ship_with_tasks(__name__)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def release() -> None:
    """Give back memory that a task no longer uses; its worker waits for the next task, beside others."""
    gc.collect()
    _trim()


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, giving back free memory after every batch and all of it when its task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield batch
            del batch
            _trim()
        release()

    return run
