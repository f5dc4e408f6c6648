"""Vectorised text primitives over Arrow string columns.

Texts are handled as one UTF-8 byte buffer with document offsets, so that
splitting into words, hashing words and hashing shingles are a handful of numpy
passes over a batch instead of a Python loop over words.  A null text counts as
empty everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word separators of the whole subpackage: blank and the ASCII controls 9 to 13.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes with A-Z mapped to a-z; every other byte stands for itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two xor-multiply rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words for a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + mix(np.full(n, seed, dtype=_U)))


_BYTE = stream(7, 256)


class _Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 18)
            up, down = np.full(size, _BASE, dtype=_U), np.full(size, _BASE_INV, dtype=_U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about `most` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and the index of each document's first word."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = WHITE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: differences of one prefix sum of a rolling polynomial."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        up, down = _POWERS.get(len(data))
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * up, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(_U) * _U(_BASE))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): k-word shingles of each document, in order, with repeats.

    A document with 1 to k-1 words has its whole sequence as its one shingle; a
    document without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out_first[1:])
    total = int(out_first[-1])
    if total == 0:
        return np.zeros(0, _U), out_first
    at = np.arange(total) + np.repeat(first[:-1] - out_first[:-1], counts)
    with np.errstate(over="ignore"):
        left = np.repeat(n, counts)
        acc = np.zeros(total, _U)
        if (left >= k).all():
            for j in range(k):
                acc = mix(acc * _U(_BASE) + h[at + j])
        else:
            for j in range(k):
                have = left > j
                nxt = mix(acc * _U(_BASE) + h[np.minimum(at + j, len(h) - 1)])
                acc = np.where(have, nxt, acc)
            acc = np.where(left < k, mix(acc + left.astype(_U)), acc)
    return acc, out_first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment."""
    if len(values) == 0:
        return values, first
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    starts = first[:-1]
    new[starts[starts < len(values)]] = True
    ranks = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=ranks[1:])
    return values[new], ranks[first]


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, A-Z lower-cased."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return distinct(*shingles(word_hashes(data, starts, ends), first, k))


def segment(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray, empty: int = 0) -> np.ndarray:
    """ufunc.reduceat over segments; empty segments get `empty`."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, first[full])
    return out


class MinHash:
    """Signatures by multiply-add permutations of 64-bit shingle hashes, folded to 32 bits each."""

    def __init__(self, size: int, seed: int = 1) -> None:
        self.size = size
        self.a = stream(seed, size) | _U(1)
        self.b = stream(seed + 1, size)

    def sign(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """uint32 matrix (documents, size); rows of empty sets hold the largest value."""
        out = np.full((len(first) - 1, self.size), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            at, work = first[full], np.empty_like(values)
            with np.errstate(over="ignore"):
                for k in range(self.size):
                    np.multiply(values, self.a[k], out=work)
                    work += self.b[k]
                    low = np.minimum.reduceat(work, at)
                    # the leading bits of a minimum are nearly constant: fold both halves
                    out[full, k] = (low ^ (low >> _U(32))) & _U(0xFFFFFFFF)
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """int64 matrix (documents, bands): a hash of each band's rows and of the band's number."""
    with np.errstate(over="ignore"):
        acc = np.repeat(stream(seed, bands)[None, :], len(signatures), axis=0)
        cube = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(_U)
        for r in range(rows):
            acc = mix(acc * _U(_BASE) + cube[:, :, r])
    return acc.view(np.int64)
