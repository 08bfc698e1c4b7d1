"""Word windows of a text as polynomial (Rabin-Karp) hashes, vectorised; used inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task keeps.
WORDS_KEPT = 200_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo 2 ** 64


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for up to WORDS_KEPT of them: places in a table of hashes."""

    def __init__(self) -> None:
        super().__init__()
        self._table, self._new = np.zeros(0, dtype=np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self._new.append(xxhash.xxh3_64_digest(word)[::-1])
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        places = np.array(list(map(self.__getitem__, words)), dtype=np.int32)
        if self._new:
            if len(self) > len(self._table):
                self._table = np.concatenate([self._table[: len(self) - len(self._new)], np.zeros(2 * len(self), dtype=np.uint64)])
            self._table[len(self) - len(self._new) : len(self)] = np.frombuffer(b"".join(self._new), "<u8")
            self._new = []
        return self._table[places]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, grown on demand."""

    def __init__(self, which: int) -> None:
        self.base = _BASES[which]
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            steps = np.full(size, self.base, dtype=np.uint64), np.full(size, self.inverse, dtype=np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = map(np.cumprod, steps)
        return self.up[:n], self.down[:n]


_POWERS = (Powers(0), Powers(1))


def rolling(x: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every window of ``length`` values, mixed; empty if there are fewer values.

    Prefix sums of x[j] * base ** -j, shifted back to the window's start: each window is the polynomial
    sum of x[i + j] * base ** -j whatever its place.
    """
    n = len(x)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS[which].upto(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x * down, out=sums[1:])
    return mixed((sums[length:] - sums[: n - length + 1]) * up[: n - length + 1], which)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log(width) passes."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        h = np.minimum(h[:-step], h[step:]) if step else h
        reach += step
    return h
