"""A bounded cache of collected results for a service on the driver."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from threading import Lock
from typing import Any


class ResultCache:
    """Least recently used entries go when the weights held exceed ``budget`` (the newest entry always
    stays); entries older than ``ttl`` seconds are not given out. A ttl of 0 turns it off."""

    def __init__(self, budget: int, ttl: float, weigh: Callable[[Any], int] = lambda _: 1, clock: Callable[[], float] = time.monotonic):
        self.budget, self.ttl, self.weigh, self.clock = budget, ttl, weigh, clock
        self.held, self.hits, self.misses = 0, 0, 0
        self._entries: OrderedDict[Any, tuple[Any, int, float]] = OrderedDict()
        self._lock = Lock()

    def __len__(self) -> int:
        return len(self._entries)

    def _drop(self, key) -> None:
        self.held -= self._entries.pop(key)[1]

    def get(self, key):
        if self.ttl <= 0:
            return None
        with self._lock:
            found = self._entries.get(key)
            if found and self.clock() - found[2] > self.ttl:
                self._drop(key)
                found = None
            if not found:
                self.misses += 1
                return None
            self._entries.move_to_end(key)
            self.hits += 1
            return found[0]

    def put(self, key, value) -> None:
        if self.ttl <= 0:
            return
        with self._lock:
            if key in self._entries:
                self._drop(key)
            weight = self.weigh(value)
            self._entries[key] = (value, weight, self.clock())
            self.held += weight
            while self.held > self.budget and len(self._entries) > 1:
                self._drop(next(iter(self._entries)))

    def sweep(self) -> None:
        with self._lock:
            now = self.clock()
            for key in [k for k, e in self._entries.items() if now - e[2] > self.ttl]:
                self._drop(key)


def filter_key(query: str, brands=(), categories=()) -> tuple:
    """A key that doesn't depend on case, blanks or order of the filters, nor on the page."""
    from offerweave.operators.filters import wanted

    return query, tuple(wanted(brands)), tuple(wanted(categories))
