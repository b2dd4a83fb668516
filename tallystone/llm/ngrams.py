"""Grams of bytes or pieces as longs, and the discounts of modified Kneser-Ney.

A gram of order k is a long whose lowest k * bits bits are its symbols, the last one lowest; above them stands a model's number, so
that several models (one for each language) share the tables. Every text is preceded by n - 1 pads (line feeds, of bytes).

Pieces are those of a SentencePiece vocabulary of up to 2**15. Words are cut at blanks and line feeds; a line feed is its byte's
piece, and so is what the vocabulary can't spell, so every text is made of known symbols.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np

from .kernel import CACHES, P, U, texts, window_hash

N = 5
PIECES, CACHE, BLOCK, WORDS = 4, 1 << 19, 1 << 20, 1 << 15


@dataclass(frozen=True)
class Unit:
    """What grams are made of: n symbols of `bits` bits, of `size` kinds; `pad` stands before a text."""

    n: int = N
    bits: int = 8
    size: int = 256
    pad: int = 10

    def symbols(self, column) -> tuple[np.ndarray, np.ndarray]:
        return texts(column)[:2]

    @property
    def models(self) -> int:
        """How many models' numbers fit above a gram."""
        return 1 << 63 - self.bits * self.n


BYTES = Unit()


@lru_cache(2)
def _processor(proto: bytes) -> tuple:
    """The vocabulary, its bytes' pieces, and the words seen in this task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if sp.get_piece_size() > 1 << 15 or not all(sp.is_byte(i) for i in byte):
        raise ValueError("the vocabulary must have up to 2**15 pieces, and those of all bytes")
    return sp, byte, Known()


CACHES.append(_processor.cache_clear)


class Known:
    """Words by hash, sorted, and where their pieces are in one array."""

    def __init__(self):
        self.hash, self.at, self.size, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(hashes), bool)
        return self.hash[np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)] == hashes

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))])
        both = np.concatenate([self.hash, hashes])
        order = np.argsort(both, kind="stable")
        self.hash, self.at, self.size = both[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def trim(self) -> None:
        if len(self.hash) > CACHE:
            self.__init__()


@dataclass(frozen=True)
class Pieces(Unit):
    n: int = PIECES
    bits: int = 15
    size: int = 1 << 15
    pad: int = 1
    proto: bytes = b""

    def symbols(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and offsets into them; each distinct word is encoded once, and the last ones of the task are kept."""
        data, offs, _ = texts(column)
        got, size, i = [], [], 0
        while i < len(offs) - 1:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, "right")) - 1)
            out, at = self._block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            got.append(out)
            size.append(np.diff(at))
            i = j
        return np.concatenate(got or [np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(np.concatenate(size))]) if size else np.zeros(1, np.int64)

    def _block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sp, byte, known = _processor(self.proto)
        start, end, hashes = spans(data, offs)
        order = np.argsort(hashes)  # np.unique sorts stably, which takes three times as long
        hashes = hashes[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
        distinct, first, which = hashes[at], order[at], np.empty(len(hashes), np.int64)
        which[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(hashes)))
        new = np.flatnonzero(~known.has(distinct))
        raw = data.tobytes()
        for i in range(0, len(new), WORDS):
            at = first[new[i : i + WORDS]]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())]
            ids = sp.encode(words, num_threads=1)
            for j, (x, got) in enumerate(zip(words, ids)):
                if x == "\n" or not got:
                    ids[j] = [byte[b] for b in (x.encode() or b" ")]
            known.add(distinct[new[i : i + WORDS]], ids)
        here = np.searchsorted(known.hash, distinct)
        each = known.size[here][which]
        place = np.append(0, np.cumsum(each))
        out = known.ids[np.repeat(known.at[here][which] - place[:-1], each) + np.arange(place[-1])]
        known.trim()
        return out, place[np.searchsorted(start, offs)]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words: runs without blanks and line feeds, each line feed, and each blank that isn't right after a run."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    feed = data == 10
    letter = (data != 32) & ~feed
    after = np.zeros(n, bool)
    after[1:] = letter[:-1] & ~first[1:n]
    start = np.flatnonzero(feed | ~after)
    stop = np.append(np.flatnonzero(~letter | first[:n]), n)
    end = np.where(letter[start], stop[np.minimum(np.searchsorted(stop, start + 1), len(stop) - 1)], start + 1)
    return start, end, window_hash(data.astype(U) + U(1), start, end, P)


def codes(data: np.ndarray, offs: np.ndarray, unit: Unit = BYTES) -> np.ndarray:
    """The order-n gram that ends at each symbol."""
    n, bits = unit.n, unit.bits
    size = np.diff(offs)
    out = np.zeros(len(data), np.int64)
    for back in range(n - 1, -1, -1):
        out <<= bits
        if back == 0:
            out |= data
        else:
            out[back:] |= data[:-back] if back < len(data) else data[:0]
            out[:back] |= unit.pad
    first = offs[:-1][size > 0]
    length = size[size > 0]
    for i in range(n - 1):  # the first symbols of a text don't follow the text before
        at = first[length > i] + i
        keep = (1 << bits * (i + 1)) - 1
        pad = sum(unit.pad << bits * j for j in range(i + 1, n))
        out[at] = out[at] & keep | pad
    return out


def cut(grams: np.ndarray, k: int, n: int, bits: int = 8) -> np.ndarray:
    """Order-k gram of the last symbols, with the model."""
    return grams >> bits * n << bits * k | grams & ((1 << bits * k) - 1)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, kept within (0, count) where too little was seen for the formula."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [i + 1 - (i + 2) * y * b / a if a else (i + 1) / 2 for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
    return tuple(min(max(d, 0.1 * (i + 1)), 0.95 * (i + 1)) for i, d in enumerate(raw))
