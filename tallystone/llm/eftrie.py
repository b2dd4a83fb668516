"""Language-model scoring by an n-gram trie of Elias-Fano sequences.

The model is interpolated modified Kneser-Ney (Chen and Goodman, 1998) over all n-grams of every document: of 4 pieces of a
SentencePiece vocabulary, or of 5 bytes (`unit`). A gram of order k is a long (see ngrams). Training is one job with two shuffles, of
sorted runs of grams packed by their differences:

1. Each task counts its documents' n-grams. Runs go to shards by the last two symbols, so a shard has all n-grams that end alike:
   read from the last symbol back, its sorted grams hold the grams of every lower order as prefixes, and a gram's continuation
   count (the distinct symbols before it) is the number of runs below it.
2. Grams of all orders go to shards by their first two symbols. A shard is a trie: level k holds, in order, the last symbols of its
   k-grams, each made monotone by adding the last value of the sibling range before (so it is read relative to its context), and
   monotone pointers to the children. Both are Elias-Fano coded.

Then the discounts are known, and each shard's counts become probabilities: a level has a byte each for the discounted probability of
a gram and the weight that it gives as a context to the order below, quantised in even steps of their logarithms over the level's range.
Sums over contexts of one symbol and the order 1, which are bounded by the vocabulary, are added up by Spark and kept in one small file.
All files lie in the shared folder and are memory-mapped by the executors.

A gram's probability is the interpolation over its orders; in each, it is looked up from the first symbol: in the children's range of
the node so far, a successor search finds the first value that isn't below base + symbol. A task looks up the distinct grams of some
megabytes of text at once, in their order, each from the place of its context.

A shard's size is set by the corpus: `each` bytes of text a shard. The grams of one pair of symbols are in one shard; they are
distinct, so repeated rows don't make a shard larger.

Edge cases: null and empty texts have a sum of 0 over 0 bytes and no perplexity. Null ids are kept; repeated rows each count
and are each scored. A very long text is a run by itself, read whole. Ties don't arise. An empty table gives none, and a model without
grams is uniform over the symbols. A text's perplexity is a byte's, whatever the unit. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import U, mix, release, slices, texts
from .ngrams import BYTES, Unit, codes, cut, discounts
from .shared import map_blob, new_path, stash, write_blob

CODES, EACH, FLUSH, SLICE, BLOCK = 254, 8 << 20, 3 << 20, 8 << 20, 1 << 14


# ---- packed runs

def firsts(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)


def pack(v: np.ndarray) -> bytes:
    """Longs, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return (mix(pair.astype(U)) % U(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)


RUNS = "shard int, level int, n int, grams binary, counts binary"
_RUNS = pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def runs(g: np.ndarray, count: np.ndarray, shard: np.ndarray, level: int) -> pa.RecordBatch:
    """Rows of RUNS of sorted distinct grams, a row a shard."""
    order = np.argsort(shard, kind="stable")
    g, count, shard = g[order], count[order], shard[order]
    at = firsts(shard)
    rows = [(int(shard[i]), level, int(j - i), pack(np.diff(g[i:j], prepend=0)), pack(count[i:j])) for i, j in zip(at, np.append(at[1:], len(g)))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)] if rows else [pa.array([], f.type) for f in _RUNS], schema=_RUNS)


def by_shard(batches):
    """(shard, its rows) of a partition; rows are packed, so those of all its shards may be held."""
    held: dict[int, list] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.setdefault(row[0], []).append(row)
    while held:
        yield held.popitem()


def merged(rows: list, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of one level and their added counts."""
    some = [r for r in rows if r[1] == level]
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.concatenate([np.cumsum(unpack(r[3], r[2])) for r in some])
    c = np.concatenate([unpack(r[4], r[2]) for r in some])
    order = np.argsort(g)
    g, c = g[order], c[order]
    at = firsts(g)
    return g[at], np.add.reduceat(c, at) if len(at) else c


def backwards(g: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Order-k grams with their symbols the other way round, under the model's number."""
    out = g >> bits * k
    for i in range(k):
        out = out << bits | g >> bits * i & ((1 << bits) - 1)
    return out


# ---- the trie

def _bits(v: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of values, packed."""
    out = np.zeros((len(v) * width + 63) // 64 + 1, U)
    if width:
        flat = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        b = np.packbits(flat.ravel(), bitorder="little")
        out.view(np.uint8)[: len(b)] = b
    return out


#: The place in a byte of its one numbered r, by byte * 8 + r.
_IN_BYTE = np.array([([j for j in range(8) if b >> j & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], U)


class EliasFano:
    """A monotone sequence: the low bits packed, the high bits in unary, with a count of ones before each word."""

    @staticmethod
    def encode(v: np.ndarray) -> tuple[dict, list[np.ndarray]]:
        n = len(v)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        ones = (v.astype(U) >> U(low)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) + 1 >> 6) + 1 if n else 1  # a zero ends it
        marks = np.zeros(size * 64, bool)
        marks[ones] = True
        high = np.packbits(marks, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint32)
        packed = np.concatenate([_bits(v[i : i + (1 << 18)], low)[:-1] for i in range(0, n, 1 << 18)] + [np.zeros(1, U)])  # 2**18 values fill whole words
        return {"n": n, "low": low}, [packed, high, before]

    def __init__(self, n: int, low: int, packed: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low, self.packed, self.high, self.before = n, low, packed, high, before
        self.gaps = self.most = None
        self.octets = np.ndarray(max(0, packed.nbytes - 7), np.int64, packed, strides=(1,))  # 8 bytes from each byte on

    def _select(self, i: np.ndarray, zeros: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the ones (or zeros) numbered i: their words' numbers, the words, and the places in them (by sums over the word's bytes)."""
        before = self._zeros() if zeros else self.before
        word = np.searchsorted(before, i.astype(np.uint32), "right") - 1  # of one type, else numpy copies `before`
        r = (i - before[word]).astype(U)
        w = ~self.high[word] if zeros else self.high[word]
        s = w - (w >> U(1) & U(0x5555555555555555))
        s = (s & U(0x3333333333333333)) + (s >> U(2) & U(0x3333333333333333))
        s = (s + (s >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)  # ones up to each byte
        byte = np.bitwise_count((r * U(0x0101010101010101) | U(0x8080808080808080)) - s & U(0x8080808080808080)).astype(U) << U(3)
        r -= s << U(8) >> byte & U(255)
        return word, w, byte + _IN_BYTE[(w >> byte & U(255)) << U(3) | r]

    def _low(self, i: np.ndarray, top: np.ndarray) -> np.ndarray:
        if not self.low:
            return top
        return top << self.low | self._rest(i)

    def _rest(self, i: np.ndarray) -> np.ndarray:
        """Low bits of values i, read from the byte in which they begin: `build` gives them up to 57."""
        at = i * self.low
        x = self.octets[at >> 3] >> (at & 7)
        x &= (1 << self.low) - 1
        return x

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word, _, place = self._select(i)
        return self._low(i, (word << 6) + place.astype(np.int64) - i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1: mostly the next one stands in the same word."""
        word, w, place = self._select(i)
        rest = w >> place >> U(1)
        near = np.bitwise_count((rest & (U(0) - rest)) - U(1))  # zeros before the next one, 64 if there is none
        top = (word << 6) + place.astype(np.int64) - i
        after = self._low(i + 1, top + near)
        far = np.flatnonzero(rest == 0)
        after[far] = self[i[far] + 1]
        return self._low(i, top), after

    def _zeros(self) -> np.ndarray:
        if self.gaps is None:
            self.gaps = (np.arange(len(self.before)) * 64 - self.before).astype(np.uint32)
        return self.gaps

    def bucket(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places from and before which values with the high bits of v stand; v is at most the last value."""
        h = v >> self.low
        word, w, place = self._select(np.maximum(h - 1, 0), True)  # the zero that ends the bucket before
        place = place.astype(U)
        rest = w >> place >> U(1)
        start = np.where(h > 0, (word << 6) + place.astype(np.int64) - h + 1, 0)
        end = start + np.bitwise_count((rest & (U(0) - rest)) - U(1))  # ones before the next zero, mostly in the same word
        far = np.flatnonzero((rest == 0) | (h == 0))
        word, _, place = self._select(h[far], True)
        end[far] = (word << 6) + place.astype(np.int64) - h[far]
        return start, np.minimum(end, self.n)

    def seek(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of each range lo:hi of rising values, the place of v, -1 if it isn't there: the last value not above v by low bits, among those that share v's high bits."""
        a, b = self.bucket(np.minimum(v, self.top))
        lo = np.maximum(lo, a)
        size = np.where(v > self.top, 0, np.maximum(np.minimum(hi, b) - lo, 0))
        if not self.low:  # nothing but high bits, so any value there is v
            return np.where(size > 0, lo, -1)
        out = np.full(len(lo), -1)
        short = np.minimum(size, 65535).astype(np.uint16)
        order = np.argsort(short, kind="stable")  # by size, so that those still to be halved stand at the end
        short = short[order]
        order = order[np.searchsorted(short, 1) :]
        short = short[len(short) - len(order) :]
        if len(order):
            at, want = lo[order], v[order] & ((1 << self.low) - 1)
            last = at + size[order] - 1
            step = 1 << max(int(size.max()) - 1, 0).bit_length() >> 1
            while step:
                m = int(np.searchsorted(short, min(step, 65534), "right"))
                next = at[m:] + step
                some = next <= last[m:]
                some &= self._rest(np.minimum(next, last[m:])) <= want[m:]
                at[m:] += some * step
                step >>= 1
            there = self._rest(at) == want
            out[order[there]] = at[there]
        return out

    @property
    def top(self) -> int:
        if self.most is None:
            self.most = int(self[np.array([self.n - 1])][0]) if self.n else 0
        return self.most

    def all(self) -> np.ndarray:
        return self[np.arange(self.n)]

    def successor(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range lo:hi, the first place whose value is v or more, and that value; hi and -1 if there is none."""
        lo, end, value = lo.copy(), hi.copy(), np.full(len(lo), -1)
        at = np.flatnonzero(lo < end)
        while len(at):
            mid = (lo[at] + end[at]) // 2
            x = self[mid]
            less = x < v[at]
            lo[at[less]] = mid[less] + 1
            end[at[~less]], value[at[~less]] = mid[~less], x[~less]
            at = at[lo[at] < end[at]]
        return lo, value


def build(grams: list[np.ndarray], bits: int) -> bytes:
    """A shard's structure from its sorted grams of orders 1, 2, ..., whose prefixes are all there. Order 1 is kept whole, with the model."""
    head, parts, size = [], [], 0
    for k, g in enumerate(grams):
        last = g & ((1 << bits) - 1)
        if k:
            parent = np.searchsorted(grams[k - 1], g >> bits)
            new = firsts(parent)
            n = np.diff(np.append(new, len(g)))
            base = np.cumsum(np.concatenate([[0], last[new + n - 1][:-1]])) if len(g) else new
            last = last + np.repeat(base, n)
        else:
            last = g
        pointer = np.searchsorted(grams[k + 1] >> bits, g) if k + 1 < len(grams) else np.zeros(0, np.int64)
        level = {}
        for name, v in (("last", last), ("pointers", np.append(pointer, len(grams[k + 1])) if k + 1 < len(grams) else pointer)):
            meta, arrays = EliasFano.encode(v)
            level[name] = meta | {"at": []}
            for a in arrays:
                level[name]["at"].append((size, len(a)))
                parts.append(a.tobytes() + bytes(-a.nbytes % 8))
                size += a.nbytes + -a.nbytes % 8
        head.append(level)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return np.array([len(text)], np.int64).tobytes() + text + b"".join(parts)


class Trie:
    """A shard: its levels' sequences and, once smoothed, a byte of log probability and one of weight for each gram, with their books."""

    def __init__(self, path: str, bits: int, values: bool = True):
        self.bits = bits
        blob = map_blob(path)
        n = int(blob[:8].view(np.int64)[0])
        body = blob[8 + n :]
        self.last, self.pointers = [], []
        for level in json.loads(bytes(blob[8 : 8 + n])):
            for name, to in (("last", self.last), ("pointers", self.pointers)):
                m = level[name]
                to.append(EliasFano(m["n"], m["low"], *(body[at : at + size * w].view(t) for (at, size), w, t in zip(m["at"], (8, 8, 4), (U, U, np.uint32)))))
        if values:
            blob = map_blob(path + ".values")
            k = len(self.last)
            books = blob[: k * 32].view(np.float64).reshape(k, 2, 2)  # by level: least and step of the logs of probabilities and weights
            self.book = [[np.append(0.0, np.exp(lo + step * np.arange(CODES))) for lo, step in level] for level in books]
            self.codes, at = [], k * 32
            for level in self.last:
                self.codes.append((blob[at : at + level.n], blob[at + level.n : at + 2 * level.n]))
                at += 2 * level.n

    def roots(self, first: np.ndarray) -> np.ndarray:
        """Places of sorted order-1 grams, -1 for none; each is searched once."""
        start = firsts(first)
        keys = self.last[0]
        lo, hi = keys.bucket(np.minimum(first[start], keys.top))
        node, value = keys.successor(lo, hi, first[start])
        node[value != first[start]] = -1
        return np.repeat(node, np.diff(np.append(start, len(first))))

    def children(self, level: int, node: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places in a level (2 or more) of symbols in the children's ranges of nodes, -1 for none: the next `size` symbols are a node's, so its range is read once."""
        values = self.last[level - 1]
        if not values.n:
            return np.full(len(symbol), -1)
        lo, hi = self.pointers[level - 2].pair(np.maximum(node, 0))
        hi[node < 0] = 0
        at = np.clip(lo, 1, max(values.n - 1, 1)) - 1
        base, value = values.pair(at) if values.n > 1 else (values[at], values[at])
        zero = np.flatnonzero(lo == 0)
        value[zero], base[zero] = base[zero], 0
        value -= base
        value[lo >= hi] = -1
        first = np.repeat(value, size)  # the first child's symbol
        out = np.where(first == symbol, np.repeat(lo, size), -1)
        more = np.flatnonzero((first < symbol) & np.repeat(hi - lo > 1, size))
        if len(more):
            group = np.repeat(np.arange(len(node)), size)[more]
            out[more] = values.seek(lo[group] + 1, hi[group], base[group] + symbol[more])
        return out

    def value(self, level: int, what: int, nodes: np.ndarray, none: float) -> np.ndarray:
        """Probabilities (0) or weights (1) of nodes of a level; `none` where there is none."""
        code = np.where(nodes >= 0, self.codes[level - 1][what][np.maximum(nodes, 0)], 0)
        book = self.book[level - 1][what]
        return np.where(code > 0, book[code], none)


def quantised(v: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(least, step, codes) of the logs of positive values; 0 is for what isn't there."""
    out = np.zeros(len(v), np.uint8)
    at = np.flatnonzero(v > 0)
    if not len(at):
        return 0.0, 0.0, out
    x = np.log(v[at])
    lo = float(x.min())
    step = (float(x.max()) - lo) / (CODES - 1)
    out[at] = 1 + (np.rint((x - lo) / step) if step else 0)
    return lo, step, out


# ---- training

class Model:
    """Where a trained model's files are."""

    def __init__(self, path: str, shards: int, unit: Unit):
        self.path, self.shards, self.unit = path, shards, unit
        self.root, self.tries = None, {}

    def __getstate__(self):
        return self.__dict__ | {"root": None, "tries": {}}

    def _root(self) -> dict:
        if self.root is None:
            with np.load(io.BytesIO(map_blob(f"{self.path}/root").tobytes())) as z:
                self.root = dict(z)
        return self.root

    @property
    def models(self) -> np.ndarray:
        """Numbers of the models that have text."""
        return self._root()["models"]

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the last symbols of distinct sorted order-n grams.

        A gram's context is a gram of the level before, so each level searches its distinct grams once, from the places found above.
        """
        n, bits, r = self.unit.n, self.unit.bits, self._root()
        levels, above, suffix = {n: keys}, {}, {}  # the places in the level before of a level's distinct contexts, and of its grams without their first symbols
        for k in range(n, 1, -1):
            g = levels[k]
            context, short = g[firsts(g >> bits)] >> bits, cut(g, k - 1, k, bits)
            order = np.argsort(short)
            short = short[order]
            at = firsts(short)
            own = short[at]
            place = np.searchsorted(own, context)
            lost = context[own[np.minimum(place, len(own) - 1)] != context] if len(own) else context  # those that only a text's start has
            above[k] = (place + np.searchsorted(lost, context)).astype(np.int32)
            suffix[k] = np.empty(len(g), np.int32)
            suffix[k][order] = np.repeat(np.arange(len(own)) + np.searchsorted(lost, own), np.diff(at, append=len(g)))
            levels[k - 1] = np.sort(np.concatenate([own, lost]))
            del context, short, order, at, own, place
        g = levels[1]
        p = find(r["symbols"], r["p1"], g, 0.0) + find(r["models"], r["w0"], g >> bits, 1.0) / self.unit.size
        node = np.zeros(0, np.int64)
        for k in range(2, n + 1):
            g = levels.pop(k)
            own, weight = np.zeros(len(g)), find(r["contexts"], r["w1"], g >> bits, 1.0) if k == 2 else np.ones(len(g))
            below, node = node, np.full(len(g), -1)
            start = firsts(g >> bits) if k > 2 else np.arange(len(g))  # a context's grams are in one shard, if it has two symbols
            size = np.diff(start, append=len(g))
            shard = shard_of(g[start] >> bits * (k - 2), self.shards)
            order = np.argsort(shard, kind="stable")
            at = firsts(shard[order])
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
                if (trie := self._trie(int(shard[order[i]]))) is not None:
                    for i in range(i, j, BLOCK):
                        some = order[i : min(i + BLOCK, j)]
                        each = size[some]
                        end = np.cumsum(each)
                        rows = np.repeat(start[some] - end + each, each) + np.arange(end[-1])
                        up = below[above[k][some]] if k > 2 else trie.roots(g[some] >> bits)
                        node[rows] = here = trie.children(k, up, each, g[rows] & ((1 << bits) - 1))
                        own[rows] = trie.value(k, 0, here, 0.0)
                        if k > 2:
                            weight[rows] = np.repeat(trie.value(k - 1, 1, up, 1.0), each)
            p = own + weight * p[suffix.pop(k)]
        return np.log(p)

    def _trie(self, s: int) -> Trie | None:
        if s not in self.tries:
            self.tries[s] = Trie(f"{self.path}/{s}", self.unit.bits) if self._root()["present"][s] else None
        return self.tries[s]


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, none: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), none)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], none)


STATS = "kind int, key long, v1 long, v2 long, v3 long, v4 long"
SYMBOL, CONTEXT, SHARD = 1, -1, 0  # other kinds are orders


def train(docs: DataFrame, text: str = "text", unit: Unit = BYTES, each: int = EACH) -> Model:
    """The model of all rows of docs, in shards of some `each` bytes of text."""
    return train_models(docs.select(F.lit(0).cast("long").alias("model"), F.col(text).alias("text")), unit, each)


def train_models(rows: DataFrame, unit: Unit = BYTES, each: int = EACH, keep=None, pooled: bool = False, total: int | None = None) -> Model:
    """Models of rows (model, text, ...), by number, in one set of shards.

    keep(batch) may filter, `total` then is the bytes of text that it leaves; pooled: 0 is a model of all the text too.
    """
    spark, n, bits = rows.sparkSession, unit.n, unit.bits
    rows = rows.where("text is not null and model is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0 if total is None else total
    shards = max(1, -(-total * (1 + pooled) // each))
    path = new_path(spark, "trie")

    def count(batches):
        held: list = []

        def flush():
            key = np.concatenate(held)
            held.clear()
            if pooled:
                low = key & ((1 << bits * n) - 1)
                key = np.concatenate([low, key[key > low]])
            key = backwards(key, n, bits)
            key.sort()
            at = firsts(key)
            g, c = key[at], np.diff(at, append=len(key))
            out = runs(g, c, shard_of(g >> bits * (n - 2), shards), n)
            del key, at, g, c
            release()
            return out

        release()
        for batch in batches:
            batch = batch if keep is None else keep(batch)
            for part in slices(batch, "text", FLUSH):
                data, offs = unit.symbols(part.column("text"))
                if len(data):
                    number = part.column("model").to_numpy().astype(np.int64)
                    held.append(codes(data, offs, unit) | np.repeat(number, np.diff(offs)) << bits * n)
                if sum(map(len, held)) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    def adjust(batches):
        for _, own in by_shard(batches):
            back, c = merged(own, n)
            own.clear()
            for k in range(n, 1, -1):
                g = backwards(back, k, bits)
                order = np.argsort(g)
                g = g[order]
                yield runs(g, c[order], shard_of(g >> bits * (k - 2), shards), k)
                at = firsts(back >> bits)
                c = np.diff(np.append(at, len(back)))  # what stands before
                back = back[at] >> bits

    def make(batches):
        for s, own in by_shard(batches):
            grams, counts = [np.zeros(0, np.int64)] * (n + 1), [np.zeros(0, np.int64)] * (n + 1)
            for k in range(n, 1, -1):
                grams[k], counts[k] = merged(own, k)
                if k < n:  # contexts that nothing but a text's start has
                    more = np.setdiff1d(grams[k + 1][firsts(grams[k + 1] >> bits)] >> bits, grams[k], assume_unique=True)
                    if len(more):
                        g = np.concatenate([grams[k], more])
                        order = np.argsort(g, kind="stable")
                        grams[k], counts[k] = g[order], np.concatenate([counts[k], np.zeros(len(more), np.int64)])[order]
            own.clear()
            two, a = grams[2], counts[2]
            grams[1] = two[firsts(two >> bits)] >> bits
            write_blob(f"{path}/{s}", build(grams[1:], bits))
            write_blob(f"{path}/{s}.counts", b"".join(np.array([len(p)], np.int64).tobytes() + p for p in map(pack, counts[2:])))
            out = [(np.array([SHARD]), np.array([s]), *[np.zeros(1, np.int64)] * 4)]
            for k in range(2, n + 1):
                number = grams[k] >> bits * k
                m, of = np.unique(number, return_inverse=True)
                out.append((np.full(len(m), k), m, *(np.bincount(of[counts[k] == i], minlength=len(m)) for i in (1, 2, 3, 4))))
            at = firsts(two >> bits)
            out.append((np.full(len(at), CONTEXT), two[at] >> bits, np.add.reduceat(a, at), *(np.add.reduceat(x.astype(np.int64), at) for x in (a == 1, a == 2, a > 2))))
            symbol, seen = np.unique((two >> 2 * bits << bits | two & ((1 << bits) - 1))[a > 0], return_counts=True)
            zero = np.zeros(len(symbol), np.int64)
            out.append((np.full(len(symbol), SYMBOL), symbol, seen, zero, zero, zero))
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], [x.split()[0] for x in STATS.split(", ")])

    packed = rows.mapInArrow(count, RUNS).repartitionById(shards, "shard").mapInArrow(adjust, RUNS)
    stats = stash(packed.repartitionById(shards, "shard").mapInArrow(make, STATS), "trie-stats")
    sums = stats.where(F.col("kind") != SHARD).groupBy("kind", "key").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in (1, 2, 3, 4)))
    sums = sums.toPandas()  # two rows a symbol and one an order, for each model: bounded by the vocabulary
    of = lambda kind: sums[sums["kind"] == kind].sort_values("key")
    present = np.zeros(shards, bool)
    present[[r.key for r in stats.where(F.col("kind") == SHARD).select("key").collect()]] = True
    symbol, context = of(SYMBOL), of(CONTEXT)
    models = np.unique(symbol["key"].to_numpy() >> bits)
    cuts = np.zeros((n + 1, len(models), 4))  # discounts of counts 0 to 3 and more
    seen, number = symbol["v1"].to_numpy(), np.searchsorted(models, symbol["key"].to_numpy() >> bits)
    for i in range(len(models)):
        cuts[1, i, 1:] = discounts(*((seen[number == i] == c).sum() for c in (1, 2, 3, 4)))
    for k in range(2, n + 1):
        o = of(k).set_index("key").reindex(models, fill_value=0)
        for i, r in enumerate(o[["v1", "v2", "v3", "v4"]].to_numpy()):
            cuts[k, i, 1:] = discounts(*r)
    d = cuts[1, number, np.minimum(seen, 3)] if len(seen) else seen
    every = np.bincount(number, seen, len(models)) if len(seen) else np.zeros(0)
    held = (context[["v2", "v3", "v4"]].to_numpy() * cuts[2, np.searchsorted(models, context["key"].to_numpy() >> bits), 1:]).sum(1) if len(context) else np.zeros(0)
    save = io.BytesIO()
    np.savez(save, present=present, models=models, cuts=cuts, symbols=symbol["key"].to_numpy(), p1=(seen - d) / every[number] if len(seen) else np.zeros(0), w0=np.bincount(number, d, len(models)) / every if len(seen) else np.zeros(0), contexts=context["key"].to_numpy(), total=context["v1"].to_numpy(), w1=held / np.maximum(context["v1"].to_numpy(), 1))
    write_blob(f"{path}/root", save.getvalue())
    model = Model(path, shards, unit)

    def smooth(batches):
        r = model._root()
        for b in batches:
            for s in b.column(0).to_pylist():
                smooth_shard(f"{path}/{s}", r, unit)
            yield b

    done = spark.range(shards).where(F.col("id").isin(np.flatnonzero(present).tolist()) if not present.all() else F.lit(True))
    done.repartitionById(shards, F.col("id").cast("int")).mapInArrow(smooth, "id long").write.format("noop").mode("overwrite").save()
    return model


def smooth_shard(path: str, r: dict, unit: Unit) -> None:
    """Writes the quantised values of a shard from its counts."""
    n, bits = unit.n, unit.bits
    trie = Trie(path, bits, values=False)
    blob, at, counts = map_blob(path + ".counts"), 0, []
    for k in range(2, n + 1):
        size = int(np.frombuffer(blob[at : at + 8].tobytes(), np.int64)[0])
        counts.append(unpack(blob[at + 8 : at + 8 + size].tobytes(), trie.last[k - 1].n))
        at += 8 + size
    keys = trie.last[0].all()
    number = np.searchsorted(r["models"], keys >> bits)
    books, values = np.zeros((n, 2, 2)), [[np.zeros(level.n, np.uint8), np.zeros(level.n, np.uint8)] for level in trie.last]
    for k in range(2, n + 1):
        a = counts[k - 2]
        pointer = trie.pointers[k - 2].all()
        size = np.diff(pointer)
        of = np.repeat(number, size)
        d = r["cuts"][k, of, np.minimum(a, 3)]
        if k == 2:
            total = r["total"][np.searchsorted(r["contexts"], keys)]
        else:
            run = np.concatenate([[0], np.cumsum(a)])
            held = np.concatenate([[0.0], np.cumsum(d)])
            total = run[pointer[1:]] - run[pointer[:-1]]
            w = np.where(total > 0, (held[pointer[1:]] - held[pointer[:-1]]) / np.maximum(total, 1), 0)
            *books[k - 2, 1], values[k - 2][1] = quantised(w)
        *books[k - 1, 0], values[k - 1][0] = quantised(np.where(a > 0, (a - d) / np.maximum(np.repeat(total, size), 1), 0))
        number = of
    write_blob(path + ".values", books.tobytes() + b"".join(v.tobytes() for pair in values for v in pair))


class Scorer:
    """Sums over texts of the log probabilities of their symbols; distinct grams are looked up once a call."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, data: np.ndarray, offs: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the sum and the sum of squares."""
        unit = self.model.unit
        key = codes(data, offs, unit) | np.repeat(number.astype(np.int64), np.diff(offs)) << unit.bits * unit.n
        order = np.argsort(key)
        key = key[order]
        at = firsts(key)
        key, size = key[at], np.diff(at, append=len(key))
        found = self.model.logp(key)
        p = np.empty(len(order))
        p[order] = np.repeat(found, size)
        out = []
        for x in (p, p * p):
            total = np.concatenate([[0], np.cumsum(x)])
            out.append(total[offs[1:]] - total[offs[:-1]])
        return out[0], out[1]


def scores(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log_prob, perplexity) of every row: natural logs, perplexity a byte."""

    def score(batches):
        release()
        run = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                size = np.diff(texts(part.column("text"))[1])
                data, offs = model.unit.symbols(part.column("text"))
                total, _ = run(data, offs, np.zeros(part.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(total)], ["id", "n", "s"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(score, "id long, n long, s double")
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_bytes"), F.col("s").alias("log_prob"), F.exp(F.expr("try_divide(-s, n)")).alias("perplexity"))
