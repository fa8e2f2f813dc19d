"""Sets of word shingles as hashes, and MinHash signatures, for many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE)
    p[:1] = 1
    return np.cumprod(p, dtype=_U)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to and with each text). Words: runs of letters and digits, in lower case; all beyond ASCII counts as letters."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    lengths = stops - starts
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = (data[word].astype(_U) + _U(1)) * _powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(_U)), np.searchsorted(starts, ends)


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `size` words; a text of fewer words, but some, is one shingle."""
    words, upto = word_hashes(texts)
    if len(words) >= size:
        n = len(words) - size + 1
        rolled = np.zeros(n, _U)
        for j in range(size):
            rolled = rolled * _STEP + words[j : j + n]
        rolled = mix(rolled)
    out = []
    start = 0
    for stop in upto.tolist():
        n = stop - start
        if n >= size:
            out.append(np.unique(rolled[start : stop - size + 1]))
        elif n:
            h = np.zeros(1, _U)
            for w in words[start:stop]:
                h = h * _STEP + w
            out.append(mix(h + _U(n)))
        else:
            out.append(np.zeros(0, _U))
        start = stop
    return out


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n hash functions, by a rule."""
    base = mix(np.arange(1, 2 * n + 1, dtype=_U) * _BASE + _U(seed))
    return base[:n] | _U(1), base[n:]


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(len(sets), n) least hashes; every set must have members."""
    factors, offsets = permutations(n)
    all_ = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((n, len(sets)), _U)
    held = np.empty_like(all_)
    for i in range(n):
        np.multiply(all_, factors[i], out=held)
        held += offsets[i]
        # High bits of a product are well mixed.
        out[i] = np.minimum.reduceat(held, at)
    return out.T


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2) 64-bit sums that tell sets apart."""
    return np.array([[np.add.reduce(mix(s + _U(1))), np.add.reduce(mix(s ^ _BASE))] for s in sets], _U).reshape(-1, 2)
