"""Words of UTF-8 texts in array operations: positions and 64-bit hashes.

A word is a longest run of bytes outside ``\\x20 \\x09-\\x0D``. These are
ASCII, so that runs of bytes are runs of code points as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random 64-bit value for each byte; a fixed seed, as hashes must agree between tasks.
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the output (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int, base: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1] = base
        done = 2
        while done < size:
            have[done : 2 * done] = have[:done] * _U(int(have[done - 1]) * base & (1 << 64) - 1)
            done *= 2
        if size <= 1 << 22:
            _powers[name] = have
    return have[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    return _power(n, _BASE, "up"), _power(n, pow(_BASE, -1, 1 << 64), "down")


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[i] = sum of value(byte j) * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_VALUE[data] * _power(len(data), _BASE, "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes in [start, end), wherever they lie."""
    if not len(start):
        return np.zeros(0, np.uint64)
    inverse = _power(len(prefix), pow(_BASE, -1, 1 << 64), "down")
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    start: np.ndarray  #: first byte of each word
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  #: which text of the run it is in
    first: np.ndarray  #: the number of words before each text; one more entry than texts


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, prefix: np.ndarray | None = None) -> Words:
    """The words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``lower``: A-Z count as a-z."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SEP[data], out=inside[1:-1])
    starts_here = np.zeros(len(data) + 1, bool)
    starts_here[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | starts_here[:-1])).astype(np.int64)
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | starts_here[1:])).astype(np.int64) + 1
    first = np.searchsorted(start, offsets)
    if prefix is None:
        prefix = prefix_hash(data)
    return Words(start, end, span_hash(prefix, start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, number of shingles before each text). A text of fewer than k words, but one at least, has one shingle: all its words."""
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    before = np.concatenate([[0], np.cumsum(count)])
    if not before[-1]:
        return np.zeros(0, np.uint64), before
    at = np.repeat(w.first[:-1] - before[:-1], count) + np.arange(before[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = np.full(len(at), 0x632BE59BD9B4E019, np.uint64)
    last = len(w.hash) - 1
    for j in range(k):
        more = mix(out * _U(0xD6E8FEB86659FD93) + w.hash[np.minimum(at + j, last)])
        out = np.where(j < size, more, out)
    return out, before
