"""Words of a text inside tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")


def kept_by_worker(name: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker made once, for its later tasks as well.

    Functions travel to workers by value, so their own globals end with a task; this hangs on a module that stays.
    """
    kept = sys.modules["pyspark"].__dict__.setdefault("_kept_by_worker", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def forgotten_by_worker(kind: str) -> None:
    """Frees what a worker keeps under names that begin with `kind`, once a later step runs that has no use for it."""
    kept = sys.modules["pyspark"].__dict__.get("_kept_by_worker", {})
    for name in [n for n in kept if n[0] == kind]:
        del kept[name]
    pa.default_memory_pool().release_unused()


def tidied(run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """`run` for a task whose worker, once the task ends, gives back to the system what it freed.

    Else an idle worker holds the most that any of its tasks took, beside an executor that goes on with other steps.
    """
    def whole(batches: Iterator[T]) -> Iterator[T]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes.split cuts at the space and U+0009 to U+000D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a text column (one longer text stands alone)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start = held = 0
        for i in range(batch.num_rows):
            size = len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
