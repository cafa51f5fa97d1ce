"""Word shingles of texts, as sorted sets of 64-bit hashes, computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}]+")
MIN_WORDS = 8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_AT_MOST = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Turns texts into sorted unique shingle hashes; remembers word hashes up to a bound."""

    def __init__(self, width: int, min_words: int = MIN_WORDS):
        self.width, self.min_words = width, max(min_words, width)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        """None for a null text or one of too few words."""
        if text is None:
            return None
        words = WORD.findall(text.lower())
        if len(words) < self.min_words:
            return None
        known = self.known
        if len(known) > _KNOWN_AT_MOST:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes[i] = h
        n = len(words) - self.width + 1
        acc = np.zeros(n, np.uint64)
        for k in range(self.width):
            acc = mix(acc * _GOLD + hashes[k : k + n] + np.uint64(k))
        return np.unique(acc)
