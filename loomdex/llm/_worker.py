"""What a Python worker keeps from one task to the next: coders and their memos of words."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_kept: dict[str, tuple[str, object]] = {}


def once(kind: str, key: str, make: Callable[[], T]) -> T:
    """One object of a kind for each worker process, not for each task; another key's object gives way."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept.pop(kind, None)
        _kept[kind] = key, make()
    return _kept[kind][1]


def release() -> None:
    """Drops all of it: called where work of another kind begins in workers that coded before."""
    _kept.clear()
