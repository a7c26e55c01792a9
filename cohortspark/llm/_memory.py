"""Values that a task computes once, within a bound on memory."""

from __future__ import annotations

from collections.abc import Callable

#: Characters of a key up to which its value is remembered: text without spaces is one long key, seen once.
LONGEST_KEY = 48
#: Weight of each of two generations.
BOUND = 64_000_000


class Remembered(dict):
    """Values by key. When keys and values weigh more than the bound, they become the older generation and that one goes."""

    def __init__(self, make: Callable, weigh: Callable[..., int], bound: int = BOUND):
        self.make, self.weigh, self.bound, self.weight, self.older = make, weigh, bound, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY:
            self.weight += 200 + self.weigh(value)
            if self.weight > self.bound:
                self.older, self.weight = dict(self), 200 + self.weigh(value)
                self.clear()
            self[key] = value
        return value
