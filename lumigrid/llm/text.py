"""Vectorised text primitives shared by the operators that run in Arrow batches.

A batch of texts is handled as one byte buffer with offsets; words are runs of bytes outside
``\\x20 \\x09-\\x0D``. Nulls count as empty texts. A text is always taken whole; batches are
sliced by bytes so that the memory of a task doesn't depend on how many rows Arrow delivers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES, LONG_SPAN = 1 << 20, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SAME = np.where(_SPACE, np.uint8(0x20), np.arange(256, dtype=np.uint8))
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: Lower case, with ASCII punctuation as space.
PLAIN = _LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column and the offsets of the rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, col.offset * 8).copy() if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if n and data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffer(batch.column(column))[1])
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of a batch: ``buf`` joins all words with one space after each; word i is
    ``buf[start[i]:start[i]+length[i]]``; row r has words ``first[r]:first[r+1]``."""

    buf: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True, table: np.ndarray | None = None) -> Words:
    """Words of the rows of ``text_buffer``; A-Z are lower-cased unless ``lower`` is false.
    ``table`` maps bytes beforehand in a way of its own; 0x20 parts words."""
    n, rows = len(buf), len(offsets) - 1
    if rows > 1:  # a space after each row, so that no word crosses rows
        gapped = np.full(n + rows, 0x20, np.uint8)
        for r in range(rows) if rows < n // 256 else ():
            gapped[offsets[r] + r : offsets[r + 1] + r] = buf[offsets[r] : offsets[r + 1]]
        if rows >= n // 256:
            gapped[np.arange(n) + np.repeat(np.arange(rows), np.diff(offsets))] = buf
        buf, offsets = gapped, offsets + np.arange(rows + 1)
    else:
        buf = np.append(buf, np.uint8(0x20))
    buf = ((_LOWER if lower else _SAME) if table is None else table)[buf]
    solid = buf != 0x20
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    out = buf[keep]
    ends = np.flatnonzero(out == 0x20)
    start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
    return Words(out, start, ends - start, np.searchsorted(np.flatnonzero(begins), offsets))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of one buffer, column by column: all spans take each step together. Long
    spans are few and are hashed one by one."""
    start, length = start.astype(np.int64), length.astype(np.int64)
    far = np.flatnonzero(length > LONG_SPAN)
    if len(far):
        import xxhash

        out = np.empty(len(start), np.uint64)
        near = np.flatnonzero(length <= LONG_SPAN)
        out[near] = xxh64(buf, start[near], length[near], seed)
        raw = memoryview(np.ascontiguousarray(buf))
        out[far] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(start[far].tolist(), length[far].tolist(), strict=True)]
        return out
    padded = np.concatenate([buf, np.zeros(40, np.uint8)])
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    half = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    seed64 = np.uint64(seed)

    def lane(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _rotl(acc + x * _P2, 31) * _P1

    with np.errstate(over="ignore"):
        h = np.full(len(start), seed64 + _P5, np.uint64)
        at = start.copy()
        live = np.flatnonzero(length >= 32)
        if len(live):
            accs = [np.full(len(live), v, np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            left, pos, on = length[live] // 32, start[live].copy(), np.arange(len(live))
            while len(on):
                for k in range(4):
                    accs[k][on] = lane(accs[k][on], wide[pos[on] + 8 * k])
                pos[on] += 32
                left[on] -= 1
                on = on[left[on] > 0]
            v = _rotl(accs[0], 1) + _rotl(accs[1], 7) + _rotl(accs[2], 12) + _rotl(accs[3], 18)
            for a in accs:
                v = (v ^ lane(np.zeros(len(live), np.uint64), a)) * _P1 + _P4
            h[live], at[live] = v, pos
        h += length.astype(np.uint64)
        stop = start + length
        rest = (stop - at) // 8
        for k in range(int(rest.max(initial=0))):
            i = np.flatnonzero(rest > k) if k or (rest < 1).any() else slice(None)
            h[i] = _rotl(h[i] ^ lane(np.uint64(0), wide[at[i] + 8 * k]), 27) * _P1 + _P4
        at += 8 * rest
        i = np.flatnonzero(stop - at >= 4)
        h[i] = _rotl(h[i] ^ (half[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[i] += 4
        for _ in range(3):
            i = np.flatnonzero(stop > at)
            h[i] = _rotl(h[i] ^ (padded[at[i]].astype(np.uint64) * _P5), 11) * _P1
            at[i] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers (the finalizer of XXH64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P3
        return x ^ (x >> np.uint64(32))


@dataclass
class Shingles:
    """Shingle spans in ``Words.buf`` and the row range of each row's shingles."""

    start: np.ndarray
    length: np.ndarray
    first: np.ndarray


def shingles(w: Words, k: int) -> Shingles:
    """All k-word shingles of each row, repeats included; a row of 1 to k-1 words has its whole
    word sequence as its only shingle; a row without words has none."""
    counts = w.counts
    per = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(counts)), per)
    a = w.first[:-1][row] + (np.arange(first[-1]) - first[:-1][row])
    b = a + np.minimum(counts[row], k) - 1
    return Shingles(w.start[a], w.start[b] + w.length[b] - w.start[a], first)


def binary(chunks: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column from one buffer and byte offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(chunks))]).cast(pa.binary())


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """An integer array as compressed bytes: differences if it rises, then one plane for each byte of
    the integers, so that small numbers and small gaps cost little."""
    import zstandard

    if rising and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, dtype: str, rising: bool = False) -> np.ndarray:
    """What ``squeeze`` was given."""
    import zstandard

    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if rising else values
