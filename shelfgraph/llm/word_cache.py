"""Encode each distinct word once: ids of all words of a chunk from the ids of those seen before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordCache:
    """Ids by 64-bit word key, in sorted arrays. It starts afresh after ``most`` distinct words, so its size is bounded."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 250_000):
        self.encode_words, self.most = encode_words, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, keys: np.ndarray, text_of: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words with these keys, and how many each has. ``text_of(places)`` gives the words at some places."""
        if len(self.keys) > self.most:
            self._clear()
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            got, sizes = self.encode_words(text_of(first[~known]))
            base = len(self.starts) - 1
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, got.astype(np.int32)])
            self.slots = np.insert(self.slots, at[~known], base + np.arange(len(sizes)))
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][back]
        sizes = self.starts[slot + 1] - self.starts[slot]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[slot] - ends + sizes, sizes) + np.arange(total)], sizes


def per_row(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the words' sizes by row; the words of row r are first[r] .. first[r + 1] - 1."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return sums[first[1:]] - sums[first[:-1]]
