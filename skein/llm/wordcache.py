"""A bounded memory of what was computed for a word."""

from __future__ import annotations

from collections.abc import Callable


class WordCache(dict):
    """``cache[word]`` computes on a first sight. Emptied when it holds ``limit`` words, so its size is bounded; what
    it gives never depends on what it holds."""

    def __init__(self, compute: Callable[[str], object], limit: int) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word: str) -> object:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = self.compute(word)
        return value
