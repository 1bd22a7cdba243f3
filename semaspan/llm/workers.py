"""Memory of Python workers, which serve the tasks of one operator after the other.

A worker forgets the tables of an operator when it begins a task of another one that asks for it, and gives back freed memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only


_forget: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Name what makes this worker forget the tables of an operator; they are made anew when they are needed."""
    _forget[operator] = forget


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(batches: Iterator[pa.Array], operator: str) -> Iterator[pa.Array]:
    """The batches of a task of an operator; before the first and after the last one the worker gives freed memory back."""
    for other, forget in _forget.items():
        if other != operator:
            forget()
    give_back()
    yield from batches
    give_back()
