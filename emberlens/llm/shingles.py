"""Word shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are what stands between these bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 2**64 - 1, 256, np.uint64)[_LOWER]  # A-Z weigh as a-z
_BYTE[_SPACE] = 0
_NEAR, _FAR, _PLACE = (_rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (4096, 4096, 16))
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of UTF-8 text, A-Z read as a-z. Works through long texts in blocks that end between words."""
    raw, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        stop = min(len(raw), at + _BLOCK)
        while stop < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[stop - 1 : stop - 1 + _BLOCK]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop = min(len(raw), stop + _BLOCK)
        b = raw[at:stop]
        word = ~_SPACE[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
            values = _BYTE[b[starts[0] :]] * _NEAR[place & 4095]
            if place.max() > 4095:
                values *= np.where(place > 4095, _FAR[(place >> 12) & 4095], np.uint64(1))
            parts.append(mix(np.add.reduceat(values, starts - starts[0])))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole sequence where there are fewer; none without words."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(words, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64) * _PLACE[15]
    for j in range(k):
        total += w[j : len(w) - k + 1 + j] * _PLACE[j]
    return np.unique(mix(total))


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
