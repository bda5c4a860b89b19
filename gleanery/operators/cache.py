"""A bounded cache of small results: least recently used entries go first, old ones expire."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class QueryCache:
    """At most ``max_size`` values for ``ttl`` seconds each. For results of bounded size, such as the rows of a top-k."""

    def __init__(self, max_size: int = 1000, ttl: float = 3600, clock: Callable[[], float] = time.monotonic):
        self.max_size, self.ttl, self._clock = max_size, ttl, clock
        self._held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()

    def get(self, key: Hashable) -> Any | None:
        until, value = self._held.get(key, (0.0, None))
        if key in self._held and self._clock() > until:
            del self._held[key]
            return None
        if key in self._held:
            self._held.move_to_end(key)
        return value

    def set(self, key: Hashable, value: Any) -> None:
        self._held.pop(key, None)
        while len(self._held) >= max(1, self.max_size):
            self._held.popitem(last=False)
        self._held[key] = self._clock() + self.ttl, value

    def through(self, key: Hashable, compute: Callable[[], Any]) -> Any:
        """The value of ``key``, computed where it is not held."""
        value = self.get(key)
        if value is None:
            value = compute()
            self.set(key, value)
        return value

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)
