"""Flat numpy views of Arrow text batches: tokens, rolling hashes, chunking.

Every operator of this subpackage that leaves the JVM works on whole Arrow
batches laid out as one byte array.  A token is a maximal run of bytes that are
not ASCII white space (9-13, 28-32); a null text counts as an empty one.  Hashes are 64 bit and
deterministic, so every executor gives the same value to the same token.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that one chunk holds at most (one longer text is a chunk of its own).
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give the system back what numpy and Arrow have freed.

    A Python worker stays from stage to stage, and its allocators keep what the largest
    batch took; beside a grown heap that is an executor's memory.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's alone
        trim(0)


def released(fn: Callable) -> Callable:
    """A kernel for mapInArrow that leaves nothing with the worker's allocators when its task ends."""

    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 permutation)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or those of its inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        steps = np.full(size, INVERSE if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[key] = have
    return have[:n]


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each pair; equal content, equal hash."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    raw = (sums[end] - sums[start]) * powers(len(values) + 1, inverse=True)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Chunk:
    """Some texts of a batch as one byte array with token bounds.

    rows: their row numbers in the batch; data: bytes; row_start: where each
    row begins in data (one more than rows); start, end: byte bounds of each token;
    row_token: the first token of each row (one more than rows).
    """

    def __init__(self, rows: np.ndarray, data: np.ndarray, row_start: np.ndarray):
        self.rows, self.data, self.row_start = rows, data, row_start

    def tokenize(self) -> Chunk:
        n = len(self.data)
        word = np.ones(n + 2, dtype=bool)
        word[0] = word[-1] = False
        np.logical_not(_SPACE[self.data], out=word[1:-1])
        # a row's end is a bound too
        flips = word[1:] != word[:-1]
        begin = flips & word[1:]
        finish = flips & word[:-1]
        edge = self.row_start[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        cut = edge[word[edge] & word[edge + 1]]
        begin[cut] = True
        finish[cut] = True
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish)
        self.row_token = np.searchsorted(self.start, self.row_start)
        return self

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each token."""
        return ranges_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end)

    def token_rows(self) -> np.ndarray:
        """For each token the index (in rows) of its row."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.row_token))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of about so many bytes; every row is in exactly one."""
    raw, offsets = buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, n)
        yield Chunk(np.arange(at, to), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, .. start[i]+length[i]-1 for all i, concatenated."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    begins = np.cumsum(length) - length
    return np.arange(total) - np.repeat(begins - start, length)
