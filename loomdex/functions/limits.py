"""Limits of a client's arguments, back-off delays, and a small cache that forgets the least recently used."""

from __future__ import annotations

import random
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOP_K, MAX_MATCHES, MAX_CONTEXT, MAX_QUERY, MAX_BODY = 100, 1000, 20, 10_000, 1 << 20
T = TypeVar("T")


class InvalidArgument(ValueError):
    """An argument is of the wrong kind or beyond its limit."""


def positive(name: str, value: object, most: int | None = None) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise InvalidArgument(f"{name} must be a positive whole number")
    if most is not None and value > most:
        raise InvalidArgument(f"{name} must be at most {most}")
    return value


def search_arguments(query: str, top_k: int = 20, max_results: int = 100, context_lines: int = 3) -> dict:
    """The checked arguments of a search; context lines are cut to their limit, the others refused beyond it."""
    if not isinstance(query, str) or not query.strip():
        raise InvalidArgument("query must be a text that is not blank")
    if len(query) > MAX_QUERY:
        raise InvalidArgument(f"query must have at most {MAX_QUERY} characters")
    if not isinstance(context_lines, int) or isinstance(context_lines, bool) or context_lines < 0:
        raise InvalidArgument("context_lines must be a whole number from 0")
    return {"query": query, "top_k": positive("top_k", top_k, MAX_TOP_K), "max_results": positive("max_results", max_results, MAX_MATCHES), "context_lines": min(context_lines, MAX_CONTEXT)}


def body_error(body: Column) -> Column:
    """Why a JSON search request (query, files) is refused, null if it is not."""
    parsed = F.from_json(body, "query string, files array<string>")
    query = parsed["query"]
    return (
        F.when(F.octet_length(body) > MAX_BODY, "too large")
        .when(body.isNull() | F.get_json_object(body, "$").isNull(), "not JSON")
        .when(query.isNull() | (F.trim(query) == ""), "no query")
        .when(F.length(query) > MAX_QUERY, "query too long")
        .when(parsed["files"].isNull(), "no files")
    )


def delays(attempts: int, base: float = 1.0, most: float = 30.0, jitter: random.Random | None = None) -> Iterator[float]:
    """Seconds to wait after each failed attempt but the last: base * 2**n up to most, or with jitter a random part of that."""
    for n in range(attempts - 1):
        whole = min(most, base * 2**n)
        yield jitter.uniform(0, whole) if jitter else whole


def with_retries(action: Callable[[], T], attempts: int = 3, base: float = 1.0, retriable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep, jitter: random.Random | None = None) -> T:
    """The action's result; its last error after so many attempts, or the first that is not worth another."""
    waits = delays(attempts, base, jitter=jitter)
    while True:
        try:
            return action()
        except Exception as failure:
            wait = next(waits, None)
            if wait is None or not retriable(failure):
                raise
            sleep(wait)


class LruCache:
    """At most ``size`` values; 0 keeps none. Counts hits, misses and evictions."""

    def __init__(self, size: int) -> None:
        self.size, self._held = size, OrderedDict()
        self.hits = self.misses = self.evicted = 0

    def get(self, key: Hashable, make: Callable[[], T]) -> T:
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.misses += 1
        value = make()
        if self.size > 0:
            self._held[key] = value
            if len(self._held) > self.size:
                self._held.popitem(last=False)
                self.evicted += 1
        return value

    def __len__(self) -> int:
        return len(self._held)
