"""A bounded memo for Python workers: two generations, so that entries in use survive and memory stays bounded."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` is ``make(key)``, kept for a while; at most 2 * ``limit`` entries are held. Keys longer than ``longest`` are never held."""

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
