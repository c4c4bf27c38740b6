"""Array kernels over Arrow string columns.

A block is a run of rows whose UTF-8 bytes lie next to each other; words, word hashes and
window hashes come from whole-array operations on those bytes, so no Python object is made
for each word. A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that are neither an ASCII letter or digit nor part of a longer code point.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*b"0123456789", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = False

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser of each element."""
    x = x.astype(np.uint64, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow; at the end of a task the worker gives the memory it no longer needs back, as it lives on beside others in its executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return whole


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = Powers(0x5851F42D4C957F2D)
_WORD_POWERS = Powers(0xD6E8FEB86659FD93)
_BYTE_CODES = splitmix(np.arange(256, dtype=np.uint64) + _U(0x1234567))


class Block:
    """Rows [first, last) of a column: bytes, row offsets and, lazily, words and their hashes."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets
        space = gaps[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        edge[-1] = True
        solid = ~space
        head = solid.copy()
        if len(data):
            head[1:] &= space[:-1] | edge[1:-1]
        tail = solid
        if len(data):
            tail = solid.copy()
            tail[:-1] &= space[1:] | edge[1:-1]
        self.starts = np.flatnonzero(head)
        self.ends = np.flatnonzero(tail) + 1
        #: Words of row r: [rows[r], rows[r + 1]).
        self.rows = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), self.n_words)

    def row_end_of_word(self) -> np.ndarray:
        """For each word the index after the last word of its row."""
        return np.repeat(self.rows[1:], self.n_words)

    def row_sums(self, at: np.ndarray) -> np.ndarray:
        """For each row the sum of a number held for each byte."""
        total = np.concatenate([[0], np.cumsum(at, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_sums(self, at: np.ndarray) -> np.ndarray:
        """For each row the sum of a number held for each word."""
        total = np.concatenate([np.zeros(1, dtype=np.result_type(at.dtype, np.int64)), np.cumsum(at)])
        return total[self.rows[1:]] - total[self.rows[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return splitmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether byte span at[i] equals byte span other[i]; hashes alone can be made to collide."""
    same = ends[at] - starts[at] == ends[other] - starts[other]
    some = np.flatnonzero(same)
    size = (ends - starts)[at[some]]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    unlike = data[np.repeat(starts[at[some]], size) + inner] != data[np.repeat(starts[other[some]], size) + inner]
    same[some] = np.bincount(np.repeat(np.arange(len(some)), size), weights=unlike, minlength=len(some)) == 0
    return same


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` items; item i of the result starts at item i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return splitmix((total[width:] - total[:-width]) * down[:n])


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES, gaps: np.ndarray = SPACE, lowered: bool = False) -> Iterator[Block]:
    """Cut a string or binary column into blocks of about max_bytes; a longer row is a block alone. Nulls are empty. `gaps` says which bytes part words."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type):
            kind, empty = np.int64, "" if pa.types.is_large_string(chunk.type) else b""
        else:
            kind, empty = np.int32, "" if pa.types.is_string(chunk.type) else b""
        if chunk.null_count:
            chunk = chunk.fill_null(empty)
        n = len(chunk)
        if not n:
            continue
        _, offs, data = chunk.buffers()
        offsets = np.frombuffer(offs, dtype=kind, count=n + 1, offset=chunk.offset * kind().itemsize).astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), n)
            own = offsets[first : last + 1]
            part = data[own[0] : own[-1]]
            yield Block(base + first, base + last, lower(part) if lowered else part, own - own[0], gaps)
            first = last
        base += n


def slide_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` items."""
    done, out = 1, keys
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step] if step else out, out[step:])
        done += step
    return out
