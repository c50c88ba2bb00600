"""What a Python worker keeps between batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class Memo(dict):
    """Values made once in each process; travels empty, so nothing kept on the driver is sent along."""

    def __reduce__(self):
        return Memo, ()

    def made(self, key: Hashable, make: Callable):
        if key not in self:
            self[key] = make()
        return self[key]
