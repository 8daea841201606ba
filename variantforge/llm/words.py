"""Hashes of words and word shingles, computed over the UTF-8 bytes of a whole Arrow column at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once: bounds the temporary arrays (about 60 bytes a byte of text).
CHUNK = 1 << 20
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = max(CHUNK + 1, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        pair = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > CHUNK + 1:
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    """``mix`` of a Python integer modulo 2^64, without arrays."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


def mix1(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. Offsets index the returned bytes."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _hash_span(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a span and the byte position of each word's start; words end at doc_starts too."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_WS[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[doc_starts] |= word[doc_starts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = doc_starts[doc_starts > 0] - 1
    last[before] |= word[before]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), s


def word_hashes(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, 64-bit hash of each word in order) for every row of a string column.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Work goes in spans of about CHUNK bytes;
    a longer text is cut at white space, so memory follows CHUNK (or one single longer word).
    """
    data, off = column_bytes(col)
    row, n = 0, len(off) - 1
    while row < n:
        if off[row + 1] - off[row] > CHUNK:
            yield row, _long(data[off[row] : off[row + 1]])
            row += 1
            continue
        stop = int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1
        stop = max(row + 1, min(stop, n))
        starts = off[row:stop] - off[row]
        span = data[off[row] : off[stop]]
        hashes, at = _hash_span(span, starts[starts < len(span)])
        cuts = np.searchsorted(at, off[row : stop + 1] - off[row])
        for k in range(row, stop):
            yield k, hashes[cuts[k - row] : cuts[k - row + 1]]
        row = stop


def _long(data: np.ndarray) -> np.ndarray:
    parts, i = [], 0
    while i < len(data):
        j = min(i + CHUNK, len(data))
        while j < len(data):
            step = data[j : j + CHUNK]
            hit = np.flatnonzero(_WS[step])
            if len(hit):
                j += int(hit[0])
                break
            j += len(step)
        parts.append(_hash_span(data[i:j], np.zeros(1, np.int64))[0])
        i = j
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_C = _rng.integers(1, 2**63, 8, dtype=np.uint64) * U64(2) + U64(1)


def shingle_set(words: np.ndarray, k: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; empty without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _C[j]
    total = mix(total)
    total.sort()
    keep = np.empty(len(total), bool)
    keep[0] = True
    np.not_equal(total[1:], total[:-1], out=keep[1:])
    return total[keep]
