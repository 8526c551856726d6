"""Word splitting and rolling window hashes on byte strings, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# A-Z to a-z; every other ASCII byte that is no letter or digit to a space.
# Bytes from 0x80 on (all of a non-ASCII character in UTF-8) stay.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
ALNUM_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20
                    for b in range(256))

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)   # multipliers of the two rolling hashes


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D (what ``bytes.split`` cuts at)."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(ALNUM_LOWER).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, odd: int = ODD[0]) -> np.ndarray:
    """Rabin-Karp value of every ``width`` consecutive hashes, modulo 2**64,
    with its bits mixed (the low bits of such a value are weak)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m, h = np.uint64(odd), hashes[:n].copy()
    for i in range(1, width):
        h *= m
        h += hashes[i:i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h
