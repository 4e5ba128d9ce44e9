"""A memory of what a Python worker has worked out, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable

#: About what a dict needs for an entry, beside the characters of the key and the value's items.
ENTRY = 200


class Recent(dict):
    """Results by key, up to about `bound` bytes. When that is passed, only entries of the keys at hand stay."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.size = bound, 0

    def missing(self, keys: set) -> set:
        return keys.difference(self)

    def keep(self, new: dict, keys: Callable[[], set]) -> None:
        """Takes new entries in; `keys` tells all that are needed now."""
        self.size += _bytes(new)
        if self.size > self.bound:
            held = {k: self[k] for k in keys() if k in self}
            self.clear()
            self.update(held)
            self.size = _bytes(held) + _bytes(new)
        self.update(new)


def _bytes(entries: dict) -> int:
    return ENTRY * len(entries) + 2 * sum(map(len, entries)) + sum(map(len, entries.values()))
