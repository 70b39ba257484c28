"""What a Python worker keeps between its tasks: the state of one function at a time, and no freed memory."""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_kept: dict[Hashable, object] = {}
#: Seconds that pass at least between two returns of freed memory.
RETURN_EVERY = 2.0
_returned = 0.0


def state(owner: Hashable, build: Callable[[], T]) -> T:
    """The state that owner built in this worker, or a new one.

    Spark reuses workers, so what one stage keeps would otherwise stay in memory beside what the next one builds:
    another owner's state is dropped first.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = build()
    return _kept[owner]


def return_memory(at_once: bool = False) -> None:
    """Give memory that was freed back to the system: an idle worker's would count against its executor's limit."""
    global _returned
    if not at_once and time.monotonic() - _returned < RETURN_EVERY:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library returns memory by itself
    _returned = time.monotonic()


def lean(f: Callable[..., Iterator[T]]) -> Callable[..., Iterator[T]]:
    """A generator function over a task's batches that returns freed memory at its end."""

    @functools.wraps(f)
    def run(*batches: Iterator) -> Iterator[T]:
        _kept.clear()  # these functions keep no state, and what others keep would stand beside what they build
        try:
            yield from f(*batches)
        finally:
            return_memory(at_once=True)

    return run

