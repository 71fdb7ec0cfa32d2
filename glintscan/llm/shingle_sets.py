"""Sets of word shingles as sorted arrays of 64-bit hashes, and their hashed bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = b" \t\n\v\f\r"
SLICE = 4_000_000
WORDS_KEPT = 500_000
ODD = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every 64-bit number as another one, all of whose bits depend on all bits."""
    values = (values ^ (values >> np.uint64(32))) * ODD[0]
    values = (values ^ (values >> np.uint64(29))) * ODD[1]
    return values ^ (values >> np.uint64(32))


def slices(data: bytes) -> Iterator[bytes]:
    """A text in slices that end between words."""
    start = 0
    while start < len(data):
        end = start + SLICE
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[start:end]
        start = end


class Shingler:
    """The shingles of texts; remembers the hashes of a bounded number of words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, data: bytes) -> np.ndarray:
        """A hash of every word; a huge text needs 8 bytes a word and one slice of it as words."""
        import xxhash

        parts = []
        for part in slices(data):
            words = part.split()
            for w in set(words).difference(self.known):
                self.known[w] = xxhash.xxh3_64_intdigest(w)
            parts.append(np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)))
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
        words = self.words(text.encode().lower())  # of bytes, lower() changes A-Z only
        n = len(words)
        if not n:
            return words
        width = min(n, self.width)
        out = np.full(n - width + 1, np.uint64(width))
        for k in range(width):
            out = (out ^ (out >> np.uint64(31))) * ODD[2 + k] + words[k:n - width + 1 + k]
        return np.unique(mixed(out))


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (a multiple of 64) parities: bit i tells if an odd number of the elements have hash i.

    Two sets differ in at least as many elements as their bitmaps in bits, whatever their sizes.
    """
    at = (mixed(values) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)
