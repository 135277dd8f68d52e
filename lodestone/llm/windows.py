"""Word windows of one text as numpy arrays: word hashes, window hashes and winnowed anchors."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd bases of two polynomial hashes modulo 2**64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Words remembered by a worker before the cache starts anew.
CACHE = 300_000


class WordHashes(dict):
    """XXH3 of words given as bytes, in 128 bits, remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word)
        return h

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the words' hashes: two hashes that have nothing to do with each other."""
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        m = max(4096, 1 << (n - 1).bit_length())
        out = []
        for base in (BASES[which], INVERSES[which]):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix(ids: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of the polynomial hash: entry i covers the first i words."""
    out = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * _powers_of(which, len(ids))[0], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(sums: np.ndarray, which: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the words from starts[i] to stops[i], wherever they stand."""
    inverse = _powers_of(which, len(sums))[1]
    return mixed((sums[stops] - sums[starts]) * inverse[starts] + np.uint64(which))


def anchors(sums: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of the winnowed grams: each is the smallest gram of the windows first to last.

    Which gram a window has follows from the window's words alone, so equal windows have equal anchors.
    """
    n = len(sums) - 1
    if n < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    at = np.arange(n - gram + 1)
    grams = span_hashes(sums, 0, at, at + gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.concatenate(([0], np.nonzero(np.diff(least))[0] + 1))
    last = np.concatenate((first[1:] - 1, [n - window]))
    place = least[first]
    return grams[place], place, first, last
