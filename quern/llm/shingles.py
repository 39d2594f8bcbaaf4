"""Word shingles as sorted 64-bit hashes, and similarity sketches of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CACHE = 100_000


class _Hashes(dict):
    """Word to 64-bit hash, filled as words come; bounded by ``word_hashes``."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def lowered_words(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def word_hashes(found: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; a bounded cache keeps those seen before."""
    if len(_hashes) > _CACHE:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, sorted; of fewer words, the whole sequence as one; of none, nothing."""
    found = lowered_words(text or "")
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Sketcher:
    """Fast similarity sketching with t coordinates.

    In round i each element is hashed to a bin and a value; a bin keeps its
    least (round, value). After t rounds, round t + j gives every element to
    bin j, so that every coordinate is filled after 2 t rounds. Rounds past
    the first that fills all bins change nothing, so several are taken at once.
    """

    def __init__(self, t: int, seed: int = 1):
        self.t = t
        self.seeds = mixed(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        self.enough = t * (np.log(t) + 3)

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        t, n = self.t, len(elements)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        at, step = 0, min(t, max(1, int(self.enough / n) + 1))
        while at < t:
            rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
            v = mixed(elements[None, :] ^ self.seeds[at : at + len(rounds), None])
            bins = ((v >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
            keys = (rounds[:, None] << np.uint64(40)) | (v & np.uint64((1 << 40) - 1))
            np.minimum.at(out, bins.ravel().astype(np.int64), keys.ravel())
            at += len(rounds)
            if out.max() != np.iinfo(np.uint64).max:
                return out
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            v = mixed(elements ^ self.seeds[t + j])
            out[j] = (np.uint64(t + j) << np.uint64(40)) | (v.min() & np.uint64((1 << 40) - 1))
        return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    s = sketch.reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64)
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return key


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
