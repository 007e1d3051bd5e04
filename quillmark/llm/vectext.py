"""Vectorised text primitives over Arrow string columns.

Texts are handled as UTF-8 byte arrays, a bounded slice of rows at a time, so memory does not
follow the batch.  Words are runs of bytes outside ``\\x20\\x09-\\x0D``; as those separators
are ASCII, splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19
#: Bytes of text whose words are hashed at once, whatever a text's length.
HASH_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE1, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(256, 1 << (n - 1).bit_length())
        known = np.full(size, base, dtype=U)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """Words of a slice of rows: byte bounds, and for row i the range bounds[i]:bounds[i+1]."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    space: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, base: int = _BASE1) -> np.ndarray:
        """A mixed 64-bit hash of each word's bytes, made HASH_BYTES at a time."""
        out, a, n = np.zeros(len(self.starts), dtype=U), 0, len(self.starts)
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + HASH_BYTES, side="right"))))
            first, last = self.starts[a], self.ends[b - 1]
            starts, length = self.starts[a:b] - first, self.ends[a:b] - self.starts[a:b]
            gap = np.diff(starts, append=last - first)
            place = np.arange(last - first, dtype=np.int64) - np.repeat(starts, gap)
            value = (self.data[first:last].astype(U) + U(1)) * powers(base, int(gap.max()))[place]
            value[self.space[first:last]] = 0
            value[place >= np.repeat(length, gap)] = 0
            out[a:b] = mix(np.add.reduceat(value, starts) ^ (length.astype(U) << U(48)))
            a = b
        return out


def column(batch_column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of an Arrow string or binary array; a null has no bytes."""
    a = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    wide = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    _, off, data = a.buffers()
    offs = np.frombuffer(off, dtype=wide, count=len(a) + a.offset + 1)[a.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(a.is_valid())
    if not valid.all() and (np.diff(offs)[~valid] > 0).any():
        return column(pa.array(a.to_pylist(), type=a.type))
    return raw, offs - offs[0], valid


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def split(raw: np.ndarray, offs: np.ndarray, i: int, j: int, lower: bool = False, gap: np.ndarray = _SPACE) -> Words:
    """The words of rows i..j-1; ``gap`` marks the bytes between words."""
    rows = offs[i : j + 1] - offs[i]
    data = raw[offs[i] : offs[j]]
    if lower:
        data = _LOWER[data]
    space = gap[data]
    word = ~space
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[rows[:-1][rows[:-1] < len(data)]] = False
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    last = rows[1:] - 1
    after[last[(last >= 0) & (rows[1:] > rows[:-1])]] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows), space)


def grams(word_hash: np.ndarray, k: int, base: int = _BASE2) -> np.ndarray:
    """Hash of each run of k words, by first word (rows are not told apart here)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    p = powers(base, k)
    out = word_hash[:n].copy()
    for t in range(1, k):
        out += word_hash[t : t + n] * p[t]
    return mix(out)


def gram_rows(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, row) of the k-word runs that lie inside one row."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(row)) - first[row] + bounds[:-1][row], row


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): row i has shingle hashes [bounds[i]:bounds[i+1]], repeats included.

    A row with 1..k-1 words has one, of its whole sequence; a row without words has none."""
    wh = w.hashes()
    counts = w.counts
    whole = grams(wh, k)
    at, _ = gram_rows(w.bounds, k)
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(bounds[-1], dtype=U)
    long = np.repeat(counts >= k, size)
    out[long] = whole[at]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        s = wh[w.bounds[r] : w.bounds[r + 1]]
        out[bounds[r]] = mix(np.array([(s * powers(_BASE1, len(s))).sum() + U(len(s))], dtype=U))[0]
    return out, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def row_sums(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of per-byte counts over each row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]
