"""numpy over whole Arrow batches of text: words, their hashes and those of n-grams.

A text is a run of UTF-8 bytes in the batch's buffer, so no Python string is made. A word is a run of
ASCII letters and digits and of bytes of other characters; each character from U+3000 up to U+DFFF (kana,
ideographs, Hangul) is a word of its own. Case is folded for ASCII and Latin-1. A null text is like an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
P, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK, SMALL = 2 << 20, 1 << 19  # bytes of text at once; of steps that hold some hundred bytes for each, the less

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WIDE = np.zeros(256, bool)
_WIDE[0xE3:0xEE] = True


#: Of each base, the longest table that was asked for.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.empty(size, U)
        p[0] = 1
        n = 1
        while n < size:
            m = min(n, size - n)
            p[n : n + m] = p[:m] * U(pow(b, n, 1 << 64))
            n += m
        out.append(p)
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, as many or more (sizes are rounded up, so that few are made)."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        _POWERS.pop(base, None)
        _POWERS[base] = _powers(base, 1 << max(16, (size - 1).bit_length()))
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Hasher:
    """Hashes of runs of values; equal runs have equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.total = np.empty(n + 1, U)
        self.total[0] = 0
        np.cumsum(values * up[:n], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U))


def window_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end]."""
    return Hasher(values, base)(start, end)


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, and off[i]:off[i+1] as those of text i."""

    data: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all k-grams that lie in one text, and their hashes."""
        at = grams_at(self.off, k)
        return at, window_hash(self.hash, at, at + k, Q)


def grams_at(off: np.ndarray, k: int) -> np.ndarray:
    n = np.diff(off)
    left = np.repeat(off[1:], n) - np.arange(off[-1])
    return np.flatnonzero(left >= k)


def folded(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    if len(out) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 32
    return out


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """offs: len + 1 byte offsets of the texts in data."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, offs, z, z, np.zeros(0, U), np.zeros(len(offs), np.int64))
    inside = _WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < n]
    begin[cut] = inside[cut]
    begin |= _WIDE[data]
    # a character right after a wide one starts anew
    wide = np.flatnonzero(_WIDE[data]) + 3
    wide = wide[wide < n]
    begin[wide] = inside[wide]
    stop = np.zeros(n + 1, bool)
    stop[1:n] = inside[:-1] & (~inside[1:] | begin[1:])
    stop[n] = inside[-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    h = window_hash(folded(data).astype(U) + U(1), start, end, P)
    return Words(data, offs, start, end, h, np.searchsorted(start, offs))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, len + 1 offsets into them, and which values are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    ok = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    column = column.cast(pa.large_string())
    _, at, body = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None and body.size else np.empty(0, np.uint8)
    offs = offs - offs[0]
    if not ok.all():  # a null may still have bytes under it
        keep = np.where(ok, np.diff(offs), 0)
        if keep.sum() != offs[-1]:
            data = data[np.repeat(ok, np.diff(offs))]
            offs = np.concatenate([[0], np.cumsum(keep)])
    return data, offs, ok


def release() -> None:
    """Gives the system back what this worker has freed: workers live on, and keep what an earlier stage's arrays took."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # of glibc
        trim(0)


#: What empties the caches that other modules keep from task to task.
CACHES: list = [_POWERS.clear]


def begin() -> None:
    """At a task's start, where an earlier stage's caches are of no use: drops them, and gives back what is free."""
    for clear in CACHES:
        clear()
    release()


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with up to `most` bytes of text; a longer text is a run by itself."""
    offs = texts(batch.column(column))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_batches(batches, column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in slices(batch, column, most):
            data, offs, _ = texts(part.column(column))
            yield part, words(data, offs)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
