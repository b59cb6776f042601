"""Walking Arrow batches in Python workers: sorted ones group by group, and giving memory back at the end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Free memory that this process holds goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` for mapInArrow, which gives memory back at a task's end: workers live on beside later stages."""

    @functools.wraps(each)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal ``keys`` (without nulls) in batches sorted by them.

    A run is held whole, so use it where the keys bound a run's size.
    """
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[at].as_py() for k in keys)
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(at, to - at))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()
