"""Splits whole batches of texts into the pieces of the public byte-level pattern, with numpy.

The pattern (``public_tokenizers.PATTERN``) has letters, digits, other signs and white space as its only classes, so the
starts of its matches follow from the class of each code point and of its neighbours. The class of a code point is asked
from the tokenizing library itself, once for each code point seen, so that library's edition of Unicode decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_BASE, _SALT = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
#: Spans up to this length are hashed together, longer ones each by xxhash: polynomials modulo 2**64 lose width on long ones.
SHORT = 32
_SEGMENT = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64."""
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(x, dtype=np.uint64)


_POWERS = powers(_BASE, SHORT)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered spans (not empty, not overlapping) of ``codes``, equal for equal content wherever it stands."""
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):  # in stretches that stay in the cache
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _SEGMENT, "right")))
        base = int(starts[low])
        a, b = starts[low:high] - base, ends[low:high] - base
        size = b - a
        brief = size <= SHORT
        if brief.any():
            a, b, size = a[brief], b[brief], size[brief]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # place within the span
            with np.errstate(over="ignore"):
                terms = (codes[base + at + np.repeat(a, size)].astype(np.uint64) + np.uint64(1)) * np.uint64(_SALT) * _POWERS[at]
                sums = np.add.reduceat(terms, np.cumsum(size) - size)
                out[low:high][brief] = mixed(sums + size.astype(np.uint64) * np.uint64(_SALT))
        for k in (low + np.flatnonzero(~brief)).tolist():
            out[k] = xxhash.xxh3_64_intdigest(codes[starts[k] : ends[k]].tobytes())
        low = high
    return out


def differing(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which spans are not equal to the span that ``like`` names for them."""
    size = ends - starts
    out = size != size[like]
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _SEGMENT, "right")))
        rows = low + np.flatnonzero(~out[low:high] & (like[low:high] != np.arange(low, high)))
        if len(rows):
            n = size[rows]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(begin, n)
            unequal = codes[at + np.repeat(starts[rows], n)] != codes[at + np.repeat(starts[like[rows]], n)]
            out[rows] = np.add.reduceat(unequal.astype(np.int32), begin) > 0
        low = high
    return out


class Splitter:
    """``joined(first, char)`` tells whether the library keeps ``first + char`` in one piece."""

    def __init__(self, joined: Callable[[str, str], bool]):
        self.joined = joined
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if len(new := np.unique(codes[found == UNKNOWN])):
            for c in new.tolist():
                self.classes[c] = next((k for k, first in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if self.joined(first, chr(c))), SPACE)
            found = self.classes[codes]
        return found

    def starts(self, codes: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Where pieces start; ``segments`` are the starts of the (not empty) texts that ``codes`` holds one after another."""
        n = len(codes)
        kind = self._classify(codes)
        fresh = np.zeros(n + 1, bool)
        fresh[segments] = fresh[n] = True
        run = fresh[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        word = kind != SPACE
        start[1:] &= ~(word[1:] & (codes[:-1] == 32) & ~fresh[1:n])  # a single space goes with what follows
        start[:-1] |= ~word[:-1] & word[1:] & ~fresh[1:n]  # the last white space before a word stands alone
        for i in np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~fresh[1:n]).tolist():
            pair = (codes[i + 1], codes[i + 2] if i + 2 < n and not fresh[i + 2] else 0)
            size = 2 if chr(pair[0]) in "stmd" else 3 if (chr(pair[0]), chr(pair[1])) in (("r", "e"), ("v", "e"), ("l", "l")) else 0
            if size:
                start[i + 1] = False
                if i + size < n:
                    start[i + size] = True
        return np.flatnonzero(start)

    def distinct(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pieces of the texts; for all pieces in order, the number of its distinct one; pieces in each text."""
        counts = np.zeros(len(texts), np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(0, np.int64), counts
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        starts = self.starts(codes, bounds[:-1][lengths > 0])
        ends = np.append(starts[1:], len(codes))
        _, first, number = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        pieces = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        others: dict[str, int] = {}  # pieces whose hash is that of another
        for i in np.flatnonzero(differing(codes, starts, ends, first[number])).tolist():
            piece = whole[starts[i] : ends[i]]
            if piece not in others:
                others[piece] = len(pieces)
                pieces.append(piece)
            number[i] = others[piece]
        at = np.searchsorted(starts, bounds)
        return pieces, number, np.diff(at)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
