"""Numbers from whole Arrow text columns: byte slices of bounded size, and vectorised hashes over them.

Words are hashed eight bytes at a time by a mixing function with a key, so no algebra between words makes two of them alike.
Stretches of bytes (`Stretches`) have three lanes that come from prefix sums, without a loop over bytes: one modulo 2^64, and
two modulo the prime 2^31 - 1 with bases of their own. The first lane alone has known collisions in long regular texts, so
whoever decides by a hash alone compares all three. Tables and keys follow from fixed seeds, so every executor has the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.Generator(np.random.PCG64(20240601))
BYTE_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII lower-casing and ASCII white space.
LOWER_TABLE = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
SPACE_TABLE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


PRIME = np.uint64((1 << 31) - 1)
_BASES = (0x2F3A1C57, 0x51D4E9B3)
_PRIME_TABLES = [_RNG.integers(1, (1 << 31) - 1, 256, dtype=np.uint64) for _ in _BASES]


def _modulo_prime(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


@lru_cache(maxsize=8)
def _prime_powers(base: int, n: int) -> np.ndarray:
    """base^i modulo the prime for i < n, n a power of two: each half follows from the one before."""
    out, factor = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate((out, _modulo_prime(out * np.uint64(factor))))
        factor = factor * factor % int(PRIME)
    return out


def _prime_size(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


class Stretches:
    """Hashes of stretches of a slice's bytes: `plain` is a uint64, `prime` a uint64 below 2^62."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_TABLE[data] * powers(n)[0], out=self.sums[1:])
        self.prime_sums = []
        for base, table in zip(_BASES, _PRIME_TABLES, strict=True):
            sums = np.zeros(n + 1, np.uint64)
            # A term is below 2^32, so sums of fewer than 2^32 bytes do not overflow.
            terms = table[data] * _prime_powers(base, _prime_size(n))[:n]
            np.cumsum((terms & PRIME) + (terms >> np.uint64(31)), out=sums[1:])
            self.prime_sums.append(sums)

    def plain(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * powers(len(self.sums))[1][starts] + (ends - starts).astype(np.uint64))

    def prime(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (ends - starts).astype(np.uint64) << np.uint64(62)
        for k, (base, sums) in enumerate(zip(_BASES, self.prime_sums, strict=True)):
            inverse = _prime_powers(pow(base, -1, int(PRIME)), _prime_size(len(sums)))[starts]
            out |= _modulo_prime(_modulo_prime(sums[ends] - sums[starts]) * inverse) << np.uint64(31 * k)
        return out


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes of these rows, n + 1 offsets into the bytes); nulls are empty. Rows are not cut, so a
    slice is longer than `most` only if it is one row."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than ASCII white space) of all rows of a slice."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE_TABLE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = ink.copy()
    opens[1:] &= ~ink[:-1] | edge[1:-1]
    closes = ink.copy()
    closes[:-1] &= ~ink[1:] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


_SHINGLE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_KEYS = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CUT = np.array([(1 << 8 * k) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of bytes, eight bytes a round; lanes (0, 1) are independent of each other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    first, later = _WORD_KEYS[2 * lane], _WORD_KEYS[2 * lane + 1]
    out = mix(eights[starts] & _CUT[np.minimum(sizes, 8)] ^ first) + sizes.astype(np.uint64) * later
    more = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    at = 8
    while len(more):
        left = np.minimum(sizes[more] - at, 8)
        out[more] = mix(out[more] * later ^ (eights[starts[more] + at] & _CUT[left]) + np.uint64(at))
        at += 8
        more = more[sizes[more] > at]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = np.frombuffer(digest, "<u8")[lane]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, second: list[int] | None = None) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `width` words (lower case); of all words if fewer. `second` takes
    another hash of each set, whose words have another key where the set is a single shingle."""
    data = LOWER_TABLE[data]
    starts, ends = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        rolled += words[i : i + len(rolled)] * _SHINGLE[i]
    rolled = mix(rolled + np.uint64(width))
    sets = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            own = np.sort(rolled[lo : hi - width + 1])
            sets.append(own if len(own) == 1 else own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif hi > lo:
            own = np.sum(words[lo:hi] * _SHINGLE[: hi - lo], dtype=np.uint64) + np.uint64(hi - lo)
            sets.append(mix(np.array([own], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        if second is not None:
            own = sets[-1]
            if len(own) == 1:
                n = min(hi - lo, width)
                own = word_hashes(data, starts[lo : lo + n], ends[lo : lo + n], 1) * _SHINGLE[width : width + n] + np.uint64(n)
            second.append(_signed_sum(mix(own * _SHINGLE[-1])))
    return sets


def _signed_sum(values: np.ndarray) -> int:
    total = int(np.sum(values, dtype=np.uint64))
    return total - (1 << 64) if total >> 63 else total


def set_hash(own: np.ndarray) -> int:
    """A signed long for a set, whatever its order."""
    return _signed_sum(mix(own ^ np.uint64(0x5851F42D4C957F2D)))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
