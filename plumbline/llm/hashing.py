"""Vectorised rolling hashes over bytes and over words.

A hash of a window is a polynomial over the units' random 64-bit codes, modulo 2**64, moved to a
common origin and mixed. All windows of one length cost a few passes over the array. Some texts have equal
hashes under every seed (a Thue-Morse sequence and its complement), so these hashes only say where to
look: what is equal is decided by bytes.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """One member of the hash family."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            self._up, self._down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                for b in (self.base, pow(self.base, -1, 2**64))
            )
        return self._up[:n], self._down[:n]

    def prefix(self, units: np.ndarray) -> np.ndarray:
        """Prefix sums of the polynomial; units: uint64 codes."""
        out = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self._powers(len(units))[0], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = self._powers(len(prefix))[1]
        return mix((prefix[ends] - prefix[starts]) * down[starts])

    def windows(self, units: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all windows of k units, by start; windows over document ends are among them."""
        if len(units) < k:
            return np.zeros(0, np.uint64)
        p = self.prefix(units)
        return mix((p[k:] - p[:-k]) * self._powers(len(units))[1][: len(units) - k + 1])


    def stretches(self, buf: np.ndarray, low: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Hashes of stretches in order of their beginnings, some of the text at a time."""
        out, a = np.empty(len(low), np.uint64), 0
        while a < len(low):
            b = max(a + 1, int(np.searchsorted(low, low[a] + most)))
            base, top = int(low[a]), int((low[a:b] + size[a:b]).max())
            out[a:b] = self.spans(self.prefix(self.codes[buf[base:top]]), low[a:b] - base, low[a:b] - base + size[a:b])
            a = b
        return out


def word_spans(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of concatenated texts, and each one's text number."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    bounds = np.cumsum(lengths)
    cut[bounds] = True
    cut[0] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right")


def join_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
