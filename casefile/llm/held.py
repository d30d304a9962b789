"""One large object per worker process.

Spark keeps Python workers between stages. What an operator builds once per worker (automata, encoders) stays for its
next task, and goes as soon as another operator runs in that worker, so that a worker holds one such object at most.
Memory that is free by then is given back to the system, as the allocators would keep it for the worker's life.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_now: dict[Hashable, object] = {}


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it has no such call


def held(key: Hashable, make: Callable[[], object]):
    """The object of this key, made if the worker holds another or none."""
    if key not in _now:
        drop()
        _now[key] = make()
        give_back()
    return _now[key]


def drop() -> None:
    """Free whatever is held; called by operators that hold nothing."""
    _now.clear()
    gc.collect()
    give_back()


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one of them took is given back before the next."""
    for batch in batches:
        yield batch
        del batch
        give_back()
