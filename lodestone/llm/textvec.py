"""Vectorised tokenising and hashing of Arrow string columns.

Texts stay in Arrow's flat byte buffer: word boundaries come from a byte table,
and the hash of any byte range from two prefix sums, so no Python object is made
per word. A range hash is ``sum(r[byte] * P**i)`` modulo 2**64, moved to position
zero by the inverse power and finished by a mixing function; ``r`` holds random
64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
FOLDED = _RANDOM[_FOLD]
EXACT = _RANDOM

_bytes = np.arange(256)
#: Digits, letters and every non-ASCII byte.
WORD_BYTES = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
VISIBLE_BYTES = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))

#: Bytes that are hashed at once, and so the length of the tables of powers.
AT_ONCE = 1 << 20


def _accumulated(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, U64)
    a[0] = 1
    return np.multiply.accumulate(a)


_POWERS, _INVERSE = _accumulated(_P, AT_ONCE), _accumulated(_PINV, AT_ONCE)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that each piece has about ``limit`` bytes of text.

    Yields (rows, offsets, bytes); a null text has no bytes. A longer text is a
    piece of its own, whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
        i, n = 0, len(arr)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            i = j


def runs(offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross texts: starts, ends, and per text the index of its first run (one more entry at the end)."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    o = offsets[:-1]
    before[o[o < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    e = offsets[1:]
    after[e[e > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def prefix(data: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    s = np.zeros(len(data) + 1, U64)
    scale = U64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), AT_ONCE):
            part = values[data[a : a + AT_ONCE]]
            part *= _POWERS[: len(part)]
            if a:
                part *= scale
            np.cumsum(part, out=s[a + 1 : a + 1 + len(part)])
            if a:
                s[a + 1 : a + 1 + len(part)] += s[a]
            scale = U64(int(scale) * int(_POWERS[-1]) * _P & 0xFFFFFFFFFFFFFFFF)
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = s[end] - s[start]
    if len(s) <= AT_ONCE:
        h *= _INVERSE[start]
    else:
        h *= _INVERSE[start & (AT_ONCE - 1)]
        h *= _accumulated(pow(_PINV, AT_ONCE, 1 << 64), len(s) // AT_ONCE + 1)[start // AT_ONCE]
    h += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """Hashes of ascending ranges that do not overlap; prefix sums are made for about ``AT_ONCE`` bytes at a time."""
    if len(data) <= 2 * AT_ONCE:
        return range_hash(prefix(data, values), start, end)
    out = np.empty(len(start), U64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + AT_ONCE, "right")))
        out[a:b] = range_hash(prefix(data[start[a] : end[b - 1]], values), start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return out


def sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each of ascending ranges that do not overlap."""
    if not len(start):
        return np.zeros(0, np.int64)
    at = np.empty(2 * len(start), np.int64)
    at[::2], at[1::2] = start, end
    got = np.add.reduceat(np.append(flags, False), at, dtype=np.int64)[::2]
    return np.where(end > start, got, 0)


_COEF = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words; a text of fewer words, but not none, is one run.

    Returns (hashes, offsets per text).
    """
    c = np.diff(first)
    n = np.where(c >= k, c - k + 1, (c > 0).astype(c.dtype))
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.repeat(first[:-1] - off[:-1], n) + np.arange(off[-1])
    length = np.repeat(np.minimum(c, k), n)
    padded = np.concatenate([h, np.zeros(k, U64)])
    out = np.zeros(len(at), U64)
    for j in range(k):
        part = padded[at + j] * _COEF[j]
        out += np.where(length > j, part, U64(0))
    return mix(out + length.astype(U64)), off


def text_words(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray = WORD_BYTES, values: np.ndarray = FOLDED):
    """(starts, ends, first, hashes) of the words of a piece."""
    start, end, first = runs(offsets, inside[data])
    return start, end, first, hash_ranges(data, start, end, values)
