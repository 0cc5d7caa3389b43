"""What a Python worker remembers between batches: bounded by bytes, freed when another operator comes.

Spark reuses Python workers, so whatever a module keeps would stay while later stages run in the
same worker. ``held`` keeps the things of one operator at a time, ``held_of`` those made of a broadcast.
``Bounded`` remembers computed bytes up to a budget.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Bytes that one ``Bounded`` remembers at most, in both generations, with the dictionaries' own cost.
BUDGET = 32 << 20
#: What an entry costs beside its key and value: two object headers and its place in the dictionary.
ENTRY = 150

_held: dict[str, Any] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Give freed pages back to the system: they would else stay with the process's allocators."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def drop() -> None:
    """Forget what is held, and give its pages back."""
    _held.clear()
    gc.collect()
    give_back()


def held(name: str, make: Callable[[], Any]) -> Any:
    """The worker's thing of this name, made at first use; one of another name is dropped before."""
    if name not in _held:
        drop()
        _held[name] = make()
        give_back()
    return _held[name]


def held_of(kind: str, shared: Any, make: Callable[[Any], Any]) -> Any:
    """What ``make`` makes of a broadcast's value, which is loaded only once the things of other names are dropped."""
    return held(f"{kind} {id(shared)}", lambda: (shared, make(shared.value)))[1]


class Bounded:
    """Remembers ``make(key)`` in two generations; what is asked for again stays."""

    def __init__(self, make: Callable[[str], bytes], longest: int = 64, budget: int = BUDGET):
        self.old: dict[str, bytes] = {}
        self.bytes = 0
        outer = self

        class Young(dict):
            def __missing__(self, key: str) -> bytes:
                found = outer.old.get(key)
                if found is None:
                    found = make(key)
                if len(key) <= longest:
                    outer.bytes += len(key) + len(found) + ENTRY
                    if outer.bytes > budget // 2:
                        outer.old = dict(self)
                        self.clear()
                        outer.bytes = len(key) + len(found) + ENTRY
                    self[key] = found
                return found

        self.get = Young().__getitem__
