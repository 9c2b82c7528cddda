"""Word and shingle hashes of many texts at once, with numpy.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash chains its
8-byte blocks through a mixing function, so that unlike a polynomial it has no pairs of strings that collide by
their form; words of more than 64 bytes go through xxh3. Everything works on UTF-8 bytes, so a text of any
language gives the same words as the same split by code points.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Keeps the first k bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_LONG = 64


def blocks_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a little-endian number; beyond the end they are 0."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; equal bytes give equal hashes wherever they stand."""
    sizes = ends - starts
    blocks = blocks_at(raw)
    out = mix(sizes.astype(U) * U(0x9E3779B97F4A7C15) + U(0xA24BAED4963EE407))
    todo = np.flatnonzero(sizes <= _LONG)
    at = starts[todo]
    left = sizes[todo]
    while len(todo):
        out[todo] = mix(out[todo] ^ (blocks[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit xxh3 digest of each byte span as a row of two numbers."""
    data = raw.tobytes()
    found = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds): text i has the words bounds[i]:bounds[i+1]."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = True, True
    np.logical_not(space, out=space)
    starts, ends = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    hashes = span_hash(_LOWER[raw], starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of the n words from each word on, in one row of words; the last n-1 have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(seed))
    for k in range(n):
        out = mix(out + hashes[k : k + m])
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; fewer words: the whole row as one; none: empty."""
    hashes, _, _, bounds = words(raw, offsets)
    every = grams(hashes, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            out.append(s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(grams(hashes[a:b], b - a, 1000 + b - a))
        else:
            out.append(np.zeros(0, U))
    return out
