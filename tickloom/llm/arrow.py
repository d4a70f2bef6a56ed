"""Small helpers of the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: ASCII white space `[\x20\x09-\x0D]`: `bytes.split()` without arguments splits at exactly these six bytes, and UTF-8
#: never uses them inside another character.
ASCII_SPACE = " \t\n\r\x0b\f"


#: Rows of an Arrow batch of whole texts.  The session's 10,000 rows of text would be held several times by each task: as a
#: buffer that doubles while it is filled, as it is sent, and in the Python worker.
TEXT_ROWS = 1_000


def byte_column(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class BoundedCache(dict):
    """A memo for a pure function of one key, of at most `limit` entries in two generations.

    When the young generation is full it becomes the old one, and what is still in use comes back from there.
    Forgetting changes speed, never results.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self._compute, self._limit, self._old = compute, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def give_back() -> None:
    """Memory that a Python worker no longer uses goes back to the machine: idle workers share it with the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


_TOOL: dict = {}


def once(build: Callable, *key):
    """`build()` once for each key in a Python worker, which serves many tasks.

    Only the last tool stays, with what it remembers: stages of one job share a worker's memory.
    """
    if key not in _TOOL:
        if _TOOL:
            _TOOL.clear()
            gc.collect()
            give_back()
        _TOOL[key] = build()
    return _TOOL[key]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
