"""Vectorised tokenising and hashing of Arrow text columns, used inside Spark tasks.

A text column is viewed as one byte buffer with offsets.  UTF-8 keeps every byte of a
non-ASCII character at 0x80 or above, so both word classes used by the operators can be
decided byte by byte without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Text bytes handled at once inside a task; bounds the temporaries, not the input.
SLICE_BYTES = 1 << 21

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_MUL = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(_MUL)
    x = x ^ (x >> _U(32))
    x = x * _U(_MUL)
    return x ^ (x >> _U(32))


def _byte_table(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_GOLD) + _U(seed)) | _U(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            out = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                out.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = out
        return self.up, self.down


_POWERS = [_Powers(0xBF58476D1CE4E5B9), _Powers(0x94D049BB133111EB)]
_TABLES = [_byte_table(17), _byte_table(0x5851F42D4C957F2D)]

#: [^\x20\x09-\x0D]+
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = (column if binary else column.cast(pa.large_string())).cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(from, to) row ranges of at most `most` text bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = text_buffer(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of consecutive texts: byte spans, text index, and word offsets by text."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: bool = False):
        raw, off = text_buffer(column)
        self.bytes, self.text_offsets = (LOWER[raw] if lower else raw), off
        self.n_texts = len(off) - 1
        self._sums: dict[int, np.ndarray] = {}
        inside = is_word[self.bytes]
        size = len(inside)
        begins, ends = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        if size:
            edge = np.zeros(size + 1, bool)
            edge[off] = True
            begins[0] = inside[0]
            begins[1:size] = inside[1:] & (~inside[:-1] | edge[1:size])
            ends[size] = inside[-1]
            ends[1:size] = inside[:-1] & (~inside[1:] | edge[1:size])
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        self.offsets = np.searchsorted(self.starts, off).astype(np.int64)
        self.counts = np.diff(self.offsets)
        self.text = np.repeat(np.arange(self.n_texts), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two families are independent."""
        return self.span_hashes(self.starts, self.ends, family)

    def _prefix_sums(self, family: int) -> np.ndarray:
        if family not in self._sums:
            up, _ = _POWERS[family].get(len(self.bytes) + 1)
            self._sums = {family: np.zeros(len(self.bytes) + 1, np.uint64)}  # one family's at a time
            np.cumsum(_TABLES[family][self.bytes] * up[: len(self.bytes)], dtype=np.uint64, out=self._sums[family][1:])
        return self._sums[family]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        sums = self._prefix_sums(family)
        _, down = _POWERS[family].get(len(self.bytes) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts])

    def byte_grams(self, k: int, family: int = 0) -> np.ndarray:
        """The same of the k bytes from each position on, as far as there are k."""
        n = max(0, len(self.bytes) - k + 1)
        sums = self._prefix_sums(family)
        _, down = _POWERS[family].get(len(self.bytes) + 1)
        return mix((sums[k : k + n] - sums[:n]) * down[:n])

    def position(self) -> np.ndarray:
        """Index of each word in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.offsets[:-1], self.counts)

    def full(self, k: int) -> np.ndarray:
        """For each word, whether k words from it on lie in its text."""
        return self.position() + k <= np.repeat(self.counts, self.counts)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; the last k - 1 entries mean nothing."""
    out = np.zeros(len(h), np.uint64)
    n = len(h) - k + 1
    if n <= 0:
        return out
    x = h[:n].copy()
    for i in range(1, k):
        x = mix_step(x, h[i : i + n])
    out[:n] = mix(x)
    return out


def mix_step(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x ^ (x >> _U(29))) * _U(_GOLD) + y


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on (fewer at the end)."""
    out, size = np.concatenate([x, np.full(w - 1, np.iinfo(x.dtype).max, x.dtype)]), 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Mask of the positions where any of the sorted keys changes."""
    n = len(keys[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys, the first one first; only rows that it leaves equal are sorted by the others."""
    order = np.argsort(keys[0])
    new = run_starts(keys[0][order])
    equal = ~new
    equal[:-1] |= ~new[1:]
    some = np.flatnonzero(equal)
    rows = order[some]
    order[some] = rows[np.lexsort([k[rows] for k in reversed(keys)])]
    return order


def covered(starts: np.ndarray, length, size: int) -> np.ndarray:
    """Mask of the positions inside any of the runs [start, start + length)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def list_offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a list column's values, flattened; a null is an empty list."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64) if len(column) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column of longs; a null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64), list_offsets(column)
