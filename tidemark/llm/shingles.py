"""Words and hashed shingles of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tidemark.llm.token_ids import _Index

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD1B54A32D192ED03)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingles of ``width`` words (lower-cased runs of word characters) as 64-bit hashes, in text order.

    A text of fewer words is one shingle, one without words has none. ``max_words`` bounds the words remembered.
    """

    def __init__(self, width: int = 5, max_words: int = 400_000):
        self.width, self.max_words = width, max_words
        self.index, self.hashes = _Index(), np.zeros(0, np.uint64)

    def word_hashes(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.max_words:
            self.index, self.hashes = _Index(), np.zeros(0, np.uint64)
        places = []
        for text in texts:
            words = WORD.findall(text.lower()) if text else []
            places.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        new, self.index.new = self.index.new, []
        fresh = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new), np.uint64, len(new))
        self.hashes = np.concatenate([self.hashes, fresh])
        return [self.hashes[p] for p in places]

    def shingles(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        width = min(self.width, len(words))
        out = words[: len(words) - width + 1].copy()
        for step in range(1, width):
            out = out * MIX + words[step : len(words) - width + 1 + step]
        return mixed(out + np.uint64(width))


def cells(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the n-th copy of a shingle is an element of its own."""
    if not len(shingles):
        return shingles
    values, count = np.unique(shingles, return_counts=True)
    if len(values) == len(shingles):
        return values
    copy = np.arange(len(shingles)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(np.repeat(values, count) + copy.astype(np.uint64) * MIX2)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given by their cells; 0 for empty ones."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
