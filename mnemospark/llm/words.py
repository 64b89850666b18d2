"""Words of a text and their multiset as 64-bit element hashes.

A word: NFKC, lower case; each Han character, each longest run of other letters
and each longest run of digits. The n-th repetition of a word in a text is an
element of its own, so the size of the intersection of two element sets is the
number of shared words counted with repetition.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+|\d+")
STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
CACHE = 400_000


def words(text: str | None) -> list[str]:
    """Words in reading order; none for null or blank text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


class ElementHasher:
    """Texts to element hashes; keeps the hashes of words seen before (bounded)."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes: list[int] = []

    def _add(self, word: str) -> int:
        self.known[word] = k = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return k

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Element hashes (uint64) of many texts end to end, in a canonical order within each, and the ends."""
        if len(self.hashes) > CACHE:
            self.known.clear()
            self.hashes.clear()
        known, add = self.known, self._add
        flat: list[int] = []
        ends = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            flat += [known[w] if w in known else add(w) for w in words(t)]
            ends[i] = len(flat)
        if not flat:
            return np.zeros(0, np.uint64), ends
        h = np.array(self.hashes, np.uint64)[np.array(flat, np.int64)]
        start = 0
        for e in ends.tolist():
            h[start:e].sort()
            start = e
        # the n-th repetition of a word is an element of its own
        new = np.concatenate([[True], h[1:] != h[:-1]])
        inner = ends[ends < len(h)]
        new[inner] = True
        at = np.arange(len(h))
        times = at - np.maximum.accumulate(np.where(new, at, 0))
        h += times.astype(np.uint64) * np.uint64(STEP)
        return h, ends

    def rows(self, texts) -> list[np.ndarray]:
        """int64 elements of each text."""
        h, ends = self.batch(texts)
        return np.split(h.view(np.int64), ends[:-1]) if len(ends) else []

    def __call__(self, text: str | None) -> np.ndarray:
        return self.rows([text])[0]


