"""Memory of Python workers: Spark keeps them for later tasks, of other operators too."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa

_CACHES: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What a worker keeps between the tasks that name it; other tasks empty it."""
    return _CACHES.setdefault(name, {})


def tidy(run: Callable, *keeps: str) -> Callable:
    """``run`` for mapInArrow, without what tasks before it have left: caches that it doesn't name go before it
    starts, and memory that Arrow and the C library hold free goes back when it ends."""
    return partial(_tidied, run, keeps)


def _tidied(run: Callable, keeps: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if dropped := [c for name, c in _CACHES.items() if c and name not in keeps]:
        for c in dropped:
            c.clear()
        release()
    try:
        yield from run(batches)
    finally:
        release()


def release() -> None:
    """Free memory goes back to the system, where its allocators can give it back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass
