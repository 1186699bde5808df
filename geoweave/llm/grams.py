"""Hashed character n-grams of a text, as sets."""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 20


class Grams:
    """Distinct hashed n-grams (of UTF-16 units, lower case) of a text. Long texts go by windows that overlap,
    so each n-gram is seen; memory stays bounded by the window and the number of hash values."""

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits
        self.last = np.zeros(1 << bits, np.int32)

    def _ids(self, units: np.ndarray) -> np.ndarray:
        u = units.astype(np.uint32)
        out = []
        for n in self.sizes:
            if len(u) < n:
                continue
            h = np.full(len(u) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h += u[i : len(u) - n + 1 + i]
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - self.bits))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _distinct(self, ids: np.ndarray) -> np.ndarray:
        place = np.arange(len(ids), dtype=np.int32)
        self.last[ids] = place
        return ids[self.last[ids] == place]

    def __call__(self, text: str) -> np.ndarray:
        units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
        found, over = np.zeros(0, np.uint32), max(self.sizes) - 1
        for at in range(0, max(1, len(units)), WINDOW):
            ids = self._distinct(self._ids(units[at : at + WINDOW + over]))
            found = self._distinct(np.concatenate((found, ids))) if at else ids
        return found
