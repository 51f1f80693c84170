"""Words, word hashes and shingles of text batches, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D after A-Z are lower-cased; ``bytes.lower`` and ``bytes.split``
do exactly that. Hashes are unsigned 64 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to hash; forgets when it holds too many words, so memory stays bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts, size: int, memo: WordHashes):
    """Yields for each text the sorted distinct hashes of its ``size``-word shingles; fewer words make one shingle."""
    look = memo.__getitem__
    for text in texts:
        words = words_of(text)
        n = len(words)
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        ids = np.fromiter(map(look, words), np.uint64, n)
        span = min(size, n)
        h = ids[: n - span + 1].copy()
        for k in range(1, span):
            h = mixed(h * _GOLD + ids[k : n - span + 1 + k])
        if n < size:
            h = mixed(h + np.uint64(n))
        h.sort()
        yield h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h
