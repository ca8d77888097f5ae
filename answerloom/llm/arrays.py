"""Numpy helpers of the executor-side steps: texts as flat arrays, words and their 64-bit names.

A name is a 64-bit digest: of a word's bytes, or of a pair of names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a task holds as arrays; a longer single text is one step.
SLICE_BYTES = 1 << 20
#: Bytes from which a word's name is a cryptographic digest.
LONG_WORD = 256
#: Bytes that are hashed at once.
_CHUNK = 1 << 20
#: Id that stands for a null id; it sorts before every other.
NULL_ID = -(1 << 63)


def _constant(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little") | 1


#: An odd multiplier with its inverse, and a random 64-bit number for each byte value.
BASE = _constant("base")
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_NAMES = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair of two names; the order counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64; those of usual slices are kept."""
    if len(known := _POWERS.get(base, ())) >= n:
        return known[:n]
    out = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= SLICE_BYTES:
        _POWERS[base] = out
    return out[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and the offset of each text (one more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # the worker process goes on with other tasks


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of `inside` bytes; a run ends with its text."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (first | ~before))
    after = np.concatenate([inside[1:], [False]])
    last = np.concatenate([first[1:], [True]])
    ends = np.flatnonzero(inside & (last | ~after)) + 1
    return starts, ends


def _chunk_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of words that lie in one chunk of bytes."""
    lo, hi = int(starts[0]), int(ends[-1])
    n = hi - lo
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_NAMES[data[lo:hi]] * powers(BASE, n), out=sums[1:])
    return (sums[ends - lo] - sums[starts - lo]) * powers(INVERSE, n + 1)[starts - lo]


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit name of each word, given by its byte range; the ranges ascend and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        if ends[i] - starts[i] > _CHUNK:  # a word of over a chunk is summed up piece by piece
            total, j = 0, i + 1
            for lo in range(int(starts[i]), int(ends[i]), _CHUNK):
                piece = np.array([lo]), np.array([min(lo + _CHUNK, int(ends[i]))])
                total += int(_chunk_names(data, *piece)[0]) * pow(BASE, lo - int(starts[i]), 1 << 64)
            out[i] = total % (1 << 64)
        else:
            out[i:j] = _chunk_names(data, starts[i:j], ends[i:j])
        i = j
    out = mix(out + (ends - starts).astype(np.uint64))
    # sums of powers modulo 2^64 can be made equal for words of some thousand bytes, so long words get a digest
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(column: pa.Array, space: np.ndarray = SPACE, lower: bool = False):
    """Words of a column of texts: (data, byte starts, byte ends, names, first word of each text and the count)."""
    data, offsets = flat(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends = spans_of(~space[data], offsets)
    return data, starts, ends, word_names(data, starts, ends), np.searchsorted(starts, offsets)


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    """Name of each window of `width` consecutive word names (windows across texts included)."""
    if len(names) < width:
        return np.zeros(0, dtype=np.uint64)
    out = names[: len(names) - width + 1]
    for j in range(1, width):
        out = pair(out, names[j : len(names) - width + 1 + j])
    return out


def stretch_names(names: np.ndarray, length: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of the units from start to end, by the names of the `length` units from each position on.

    A stretch is at least `length` long: its name folds the names at every `length`-th unit, the last one aligned to
    its end.
    """
    last = end - length
    one = names[start]
    two = mix(one ^ (end - start).astype(np.uint64))
    at = start
    while (more := at < last).any():
        at = np.minimum(at + length, last)
        here = names[at]
        one = np.where(more, pair(one, here), one)
        two = np.where(more, pair(here, two), two)
    return one, two


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
