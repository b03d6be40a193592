"""Words, lines and rolling hashes of many texts at once, in numpy over UTF-8 bytes.

All hashes are polynomials over wrapping 64-bit integers with random coefficients per byte, finished
by a bijective mixer, so that equal content has equal hashes wherever it stands.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
#: A random odd value for each byte and for each of two independent hashes.
_BYTES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
_BASE = [int(x) | 1 for x in _rng.integers(2**62, 2**63, 4, dtype=np.uint64)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Separators of plain words: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PLAIN = ~SPACE
#: Words of license texts: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least; odd bases have inverses."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 17)
        base = _BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Sums of values[j] * base**j over j below i, for every i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return mix((pre[end] - pre[start]) * powers(which, len(pre))[1][start])


class Words:
    """The words of several texts: start and end byte, document, and position of each text's first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray = PLAIN, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.off, self.docs = off, len(off) - 1
        inside = kind[self.data]
        n = len(inside)
        cuts = np.zeros(n + 1, bool)
        cuts[off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cuts[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cuts[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, off)  # the words of text d are at[d]:at[d+1]
        self.n = np.diff(self.at)
        self.doc = np.repeat(np.arange(self.docs), self.n)
        self._chars = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def char_prefix(self) -> np.ndarray:
        """Code points before each byte."""
        if self._chars is None:
            self._chars = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum((self.data & 0xC0) != 0x80, out=self._chars[1:])
        return self._chars

    def chars(self) -> np.ndarray:
        c = self.char_prefix
        return c[self.end] - c[self.start]

    def hashes(self, which: int = 0) -> np.ndarray:
        return spans_hash(prefix(_BYTES[which][self.data], which), self.start, self.end, which)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word by text."""
        total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
        np.cumsum(values, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def windows(self, k: int) -> np.ndarray:
        """The first words of all windows of k words that lie in one text."""
        if len(self) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self) - k + 1] == self.doc[k - 1 :])


def gathered(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of data from each start on, one behind another."""
    ends = np.cumsum(lengths)
    return data[np.repeat(start - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def window_hash(h: np.ndarray, starts: np.ndarray, k: int, which: int = 2) -> np.ndarray:
    return spans_hash(prefix(h, which), starts, starts + k, which)


def repeated(key: np.ndarray) -> np.ndarray:
    """Which entries have a value that occurs twice or more."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    return among(key, twice)


def among(key: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which entries are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(key), bool)
    at = np.searchsorted(ordered, key)
    at[at == len(ordered)] = 0
    return ordered[at] == key


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words a window of k words from one of the starts covers."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + k, minlength=n + 1)
    return np.cumsum(step)[:n] > 0
