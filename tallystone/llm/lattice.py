"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations are the paths of a lattice of pieces, with probability in proportion to the product of the pieces'
weights. The k samples are the first k of an exponential race in which a segmentation of probability p arrives at an
Exp(p) time; minus the log of an arrival is the segmentation's Gumbel-perturbed log probability (Kool et al., 2019). The race is
searched best-first, A* with exact perturbed bounds: the first arrival is a sample of the whole lattice; what is left of the
lattice falls into branches (a prefix of the last sample, then anything else), each of which has one arrival time, the bound of all
its paths; the earliest branch holds the next sample, and is split in turn. Time k + 1 gives the inclusion scores.

No piece spans the end of a word, so the lattice of a text is a chain of small ones, those of its words. Word lattices are
built for the distinct words of a batch at once in numpy, and walked for all their occurrences at once.

A vocabulary made by merges has ranks in place of probabilities; `weights="zipf"` gives rank r the weight 1 / (r + 1), and
"score" takes the model's own scores. A character without a piece becomes its UTF-8 bytes' pieces, or the unknown piece.

Random numbers are hashes of (seed, row key, sample, word, step), so a row's samples don't depend on its neighbours.

Edge cases: a null text gives no rows, an empty one a single sample without pieces. Fewer than k segmentations give fewer rows.
Rows with the same key and text have the same samples; null keys are alike. Ids that a model lacks raise in decoding; null
ids give a null text. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .kernel import P, U, begin, mix, powers, slices, texts, window_hash

SPACE = 0x2581
SLICE = 1 << 19


class Vocabulary:
    """Pieces of a SentencePiece model and a table of the hashes of their prefixes."""

    def __init__(self, proto: bytes, weights: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1)
        usable = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable[p] = i
        self.unknown = sp.unk_id()
        rank = np.arange(n)
        w = -np.log(rank + 1.0) - np.log(np.log(n + 1.0)) if weights == "zipf" else np.array([sp.get_score(i) for i in range(n)])
        self.weight = alpha * w
        self.dummy = len(sp.encode("a")) > 0 and sp.encode_as_pieces("a")[0].startswith("▁")
        self.parts = any(p[i] != "▁" and p[i + 1] == "▁" for p in usable for i in range(len(p) - 1))
        body = {i: p.replace("▁", " ").encode() for p, i in usable.items()}
        body |= {int(i): bytes([b]) for b, i in enumerate(self.byte) if i >= 0}
        body[self.unknown] = " ⁇ ".encode()
        size = np.array([len(body.get(i, b"")) for i in range(n)])
        self.bytes, self.bytes_at = np.frombuffer(b"".join(body.get(i, b"") for i in range(n)), np.uint8), np.concatenate([[0], np.cumsum(size)])
        known = sorted({c for p in usable for c in p})
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in known]] = True
        prefixes: dict[str, int] = {}
        for p, i in usable.items():
            for j in range(1, len(p)):
                prefixes.setdefault(p[:j], -1)
            prefixes[p] = i
        names = list(prefixes)
        chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(p) for p in names])])
        key = window_hash(mix(chars.astype(U) + U(1)), at[:-1], at[1:], P)
        bits = max(4, (4 * len(names) - 1).bit_length())
        self.mask = U((1 << bits) - 1)
        self.keys, self.ids = np.zeros(1 << bits, U), np.full(1 << bits, -2, np.int32)
        for k, p in zip(key.tolist(), names):
            slot = k & int(self.mask)
            while self.ids[slot] != -2:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.ids[slot] = k, prefixes[p]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece ids, -1 for a prefix only, -2 for neither."""
        slot = (key & self.mask).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.ids[slot], -2)
        at = np.flatnonzero((out == -2) & (self.ids[slot] != -2))
        while len(at):
            slot[at] = (slot[at] + 1) & int(self.mask)
            out[at] = np.where(self.keys[slot[at]] == key[at], self.ids[slot[at]], -2)
            at = at[(out[at] == -2) & (self.ids[slot[at]] != -2)]
        return out


@lru_cache(4)
def _vocabulary(digest: str, weights: str, alpha: float) -> Vocabulary:
    return Vocabulary(_protos[digest], weights, alpha)


_protos: dict[str, bytes] = {}


def vocabulary(proto: bytes, weights: str = "zipf", alpha: float = 1.0) -> Vocabulary:
    digest = hashlib.sha256(proto).hexdigest()
    _protos[digest] = proto
    return _vocabulary(digest, weights, alpha)


class Lattices:
    """Lattices of distinct words. Node j of word i is off[i] + i + j; the edges of a node are together, the longest first."""

    def __init__(self, v: Vocabulary, chars: np.ndarray, off: np.ndarray):
        n = len(chars)
        values = mix(chars.astype(U) + U(1))
        up, down = powers(P, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=total[1:])
        word = np.repeat(np.arange(len(off) - 1), np.diff(off))
        left = off[word + 1] - np.arange(n)
        start, size, piece = [], [], []
        at, length = np.arange(n), 1
        single = np.zeros(n, bool)
        while len(at):
            got = v.find(mix((total[at + length] - total[at]) * down[at] + U(length)))
            hit = got >= 0
            start.append(at[hit].astype(np.int32))
            size.append(np.full(hit.sum(), length, np.int32))
            piece.append(got[hit].astype(np.int32))
            if length == 1:
                single[at[hit]] = True
            at = at[got > -2]
            length += 1
            at = at[left[at] >= length]
        lone = np.flatnonzero(~single)
        start.append(lone.astype(np.int32))
        size.append(np.ones(len(lone), np.int32))
        piece.append((-1 - chars[lone]).astype(np.int32))  # a character without a piece
        start, size, piece = (np.concatenate(x[::-1]) for x in (start, size, piece))
        order = np.argsort(start, kind="stable")
        start, size, self.piece = start[order], size[order], piece[order]
        del order, piece, values, total, at
        w = np.empty(len(start))
        whole = self.piece >= 0
        w[whole] = v.weight[self.piece[whole]]
        w[~whole] = [v.weight[spell(v, int(-1 - c))].sum() for c in self.piece[~whole]]
        self.w = w
        node = (start + word[start]).astype(np.int32)
        self.to = node + size
        del size
        nodes = n + len(off) - 1
        self.first = np.searchsorted(node, np.arange(nodes + 1))
        self.root, self.end = off[:-1] + np.arange(len(off) - 1), off[1:] + np.arange(len(off) - 1)
        far = left[start].astype(np.int32)
        del start, left, word
        beta = np.full(nodes, -np.inf)
        beta[self.end] = 0
        order = np.argsort(np.minimum(far, 65535).astype(np.uint16), kind="stable")
        if len(far) and far.max() > 65535:
            order = np.argsort(far, kind="stable")
        ranked = far[order]
        cuts = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [len(ranked)]]) if len(ranked) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e = order[i:j]
            f = node[e]
            s = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            x = w[e] + beta[self.to[e]]
            top = np.maximum.reduceat(x, s)
            count = np.diff(np.concatenate([s, [len(e)]]))
            beta[f[s]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count)), s))
        self.beta = beta
        del order, ranked, far
        share = np.exp(w + beta[self.to] - beta[node])
        run = np.cumsum(share)
        self.upto = run - np.repeat(np.concatenate([[0], run])[self.first[:-1]], np.diff(self.first))
        last = self.first[1:][np.diff(self.first) > 0] - 1
        self.upto[last] = 2.0

    def walk(self, words: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A sample of each word: (edges in order, first edge of each word, log probability)."""
        at = np.arange(len(words), dtype=np.int32)
        node, end = self.root[words], self.end[words]
        who, edges = [], []
        step = 0
        while len(at):
            u = uniform(mix(seed[at] + U(step)))
            e = self.first[node]
            more = np.flatnonzero(self.upto[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] <= u[more]]
            who.append(at)
            edges.append(e)
            node = self.to[e]
            live = node != end
            at, node, end = at[live], node[live], end[live]
            step += 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)
        who, edges = np.concatenate(who), np.concatenate(edges)
        edges = edges[np.argsort(who, kind="stable")]
        count = np.bincount(who, minlength=len(words))
        off = np.concatenate([[0], np.cumsum(count)])
        return edges, off, np.add.reduceat(self.w[edges], off[:-1]) - self.beta[self.root[words]]

    def sample_but(self, word: int, but: list[tuple[int, ...]], draw) -> tuple[int, ...]:
        """A sample of a word's segmentations (as edges) other than those in but; empty if rounding leaves none."""
        node, end, path, base = int(self.root[word]), int(self.end[word]), (), -float(self.beta[self.root[word]])
        left = [(x, math.exp(self.logp(word, x))) for x in but]
        while node != end:
            lo, hi = int(self.first[node]), int(self.first[node + 1])
            to = self.to[lo:hi].tolist()
            mass = np.exp(base + self.w[lo:hi] + self.beta[self.to[lo:hi]]).tolist()
            n = len(path)
            for x, p in left:
                mass[x[n] - lo] -= p
                if to[x[n] - lo] == end:
                    mass[x[n] - lo] = 0.0  # whatever rounding leaves of an excluded path
            mass = [m if m > 0 else 0.0 for m in mass]
            total = sum(mass)
            if total <= 0:
                return ()
            u, i = draw() * total, 0
            while i < len(mass) - 1 and (u >= mass[i] or mass[i] == 0):
                u -= mass[i]
                i += 1
            while mass[i] == 0:
                i -= 1
            path += (lo + i,)
            base += float(self.w[lo + i])
            node = to[i]
            left = [(x, p) for x, p in left if x[n] == lo + i]
        return path

    def logp(self, word: int, path: tuple[int, ...]) -> float:
        return float(self.w[list(path)].sum() - self.beta[self.root[word]])


def spell(v: Vocabulary, char: int) -> np.ndarray:
    ids = v.byte[np.frombuffer(chr(char).encode("utf-8", "replace"), np.uint8)]
    return ids if (ids >= 0).all() else np.array([v.unknown])


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(float) + 0.5) / 2.0**53


def split(v: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters with SentencePiece's spaces, starts of words in them, and the first word of each text."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = [data[np.minimum(at + i, len(data) - 1)].astype(np.int32) for i in range(4)] if len(data) else [np.zeros(0, np.int32)] * 4
    cp = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)))
    cp[cp == 32] = SPACE
    off = np.searchsorted(at, offs)
    full = np.flatnonzero(np.diff(off) > 0)
    if v.dummy:
        cp = np.insert(cp, off[full], SPACE)
        off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
    start = np.zeros(len(cp), bool)
    if not v.parts:
        space, known = cp == SPACE, v.known[cp]
        start[1:] = (space[1:] & ~space[:-1]) | ~known[1:] | ~known[:-1]
    start[off[full]] = True
    starts = np.flatnonzero(start)
    return cp, starts, np.searchsorted(starts, off)


def sample_batch(v: Vocabulary, data: np.ndarray, offs: np.ndarray, keys: np.ndarray, k: int, seed: int) -> list[tuple]:
    """(text, rank, log p, Gumbel score, log inclusion, ids) of the samples of each text."""
    cp, starts, first = split(v, data, offs)
    ends = np.concatenate([starts[1:], [len(cp)]])
    h = window_hash(mix(cp.astype(U) + U(1)), starts, ends, P)
    _, which, word = np.unique(h, return_index=True, return_inverse=True)
    size = (ends - starts)[which]
    off = np.concatenate([[0], np.cumsum(size)])
    chars = cp[np.repeat(starts[which] - off[:-1], size) + np.arange(off[-1])] if len(which) else cp[:0]
    lat = Lattices(v, chars, off)
    count = np.diff(first)
    key = mix(keys.view(U) ^ mix(np.full(len(keys), seed, np.int64).view(U) + U(99)))
    local = np.arange(len(starts)) - np.repeat(first[:-1], count)
    base = mix(np.repeat(key, count) + local.astype(U) * U(0x9E3779B97F4A7C15))
    walks = [lat.walk(word, mix(base ^ U(0xABCD * (j + 1)))) for j in range(k)]
    others = [np.log(np.maximum(-np.expm1(np.minimum(w[2], 0)), 1e-300)) for w in walks]
    for w, f in zip(walks, others):
        f[w[2] > -1e-13] = -np.inf  # the only segmentation
    exp = [-np.log(uniform(mix(base ^ U(0x1234567 * (j + 1))))) for j in range(k)]
    wide = bool((lat.piece < 0).any())
    out = []
    for d, (a, b, x) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), key.tolist())):
        race = _Race(lat, word, walks, others, exp, a, b, x)
        done, kappa = race.run(k)
        for rank, (lp, arrived, parts) in enumerate(done):
            ids = lat.piece[np.concatenate(parts) if parts else np.zeros(0, np.int64)]
            if wide and (ids < 0).any():
                if (ids < -128).any() or (v.byte < 0).any():
                    ids = np.concatenate([spell(v, int(-1 - i)) if i < 0 else np.array([i]) for i in ids])
                else:  # ASCII characters are one byte each
                    ids = np.where(ids < 0, v.byte[np.clip(-1 - ids, 0, 255)], ids)
            out.append((d, rank, lp, -math.log(arrived), _log_inclusion(lp, kappa), ids.astype(np.int32)))
    return out


class _Race:
    """The race of one text, of words a to b. It holds no reference to itself, so its arrays go when it does."""

    def __init__(self, lat: Lattices, word, walks, others, exp, a: int, b: int, key: int):
        self.lat, self.word, self.walks, self.others, self.exp, self.a, self.b = lat, word, walks, others, exp, a, b
        self.state = key ^ 0xFEED
        # a path: fresh word by word from sample j on, before that as its parent, with a word of its own between
        self.paths: list[tuple] = [(None, 0, None, None)]
        self.branches: list[tuple[float, int, int, tuple]] = []  # (arrival, path, word, excluded)

    def draw(self) -> float:
        """The next of a stream of uniform numbers (SplitMix64)."""
        self.state = (self.state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return (((z ^ (z >> 31)) >> 11) + 0.5) / 2.0**53

    def edges_of(self, p: int, lo: int, hi: int) -> list[np.ndarray]:
        parent, j, at, own = self.paths[p]
        e, o, _ = self.walks[j]
        if parent is None:
            return [e[o[lo] : o[hi]]]
        got = self.edges_of(parent, lo, min(hi, at)) if lo < at else []
        if lo <= at < hi:
            got.append(np.array(own, np.int64))
        if hi > at + 1:
            got.append(e[o[max(lo, at + 1)] : o[hi]])
        return got

    def prefix(self, p: int, at: int) -> float:
        """Log probability of the words before at."""
        parent, j, w, own = self.paths[p]
        lp = self.walks[j][2]
        if parent is None:
            return float(lp[self.a : at].sum())
        if at <= w:
            return self.prefix(parent, at)
        return self.prefix(parent, w) + self.lat.logp(int(self.word[w]), own) + float(lp[w + 1 : at].sum())

    def open_branches(self, p: int, j: int, lo: int, before: float, t: float, k: int) -> None:
        """Branches off path p at its fresh words lo and on; of one path at most k can be among the first k + 1 arrivals."""
        b = self.b
        if lo >= b:
            return
        lp = self.walks[j][2][lo:b]
        mass = before + np.cumsum(lp) - lp + self.others[j][lo:b]
        arrive = t + self.exp[j][lo:b] * np.exp(np.minimum(-mass, 700.0))  # later than any that counts
        arrive[mass < -690] = np.inf
        few = np.argpartition(arrive, k - 1)[:k] if len(arrive) > k else range(len(arrive))
        self.branches += [(float(arrive[i]), p, lo + int(i), ()) for i in few if arrive[i] < np.inf]

    def run(self, k: int) -> tuple[list[tuple], float]:
        a, b, lat = self.a, self.b, self.lat
        t = -math.log(self.draw())
        done = [(self.prefix(0, b), t, self.edges_of(0, a, b))]
        self.open_branches(0, 0, a, 0.0, t, k)
        while self.branches and len(done) < k:
            i = min(range(len(self.branches)), key=lambda x: self.branches[x][0])
            t, p, at, but = self.branches.pop(i)
            but = but or (tuple(np.concatenate(self.edges_of(p, at, at + 1)).tolist()),)
            w = int(self.word[at])
            own = lat.sample_but(w, list(but), self.draw)
            if not own:
                continue
            j = len(done)
            self.paths.append((p, j, at, own))
            new = len(self.paths) - 1
            before = self.prefix(p, at)
            done.append((self.prefix(new, b), t, self.edges_of(new, a, b)))
            rest = 1.0 - sum(math.exp(lat.logp(w, x)) for x in (*but, own))
            if rest > 1e-12 and before + math.log(rest) > -690:
                self.branches.append((t - math.log(self.draw()) * math.exp(-(before + math.log(rest))), p, at, (*but, own)))
            self.open_branches(new, j, at + 1, before + lat.logp(w, own), t, k)
        return done, min((x[0] for x in self.branches), default=math.inf) if len(done) == k else math.inf


def _log_inclusion(lp: float, kappa: float) -> float:
    """log(1 - exp(-p * kappa)): how likely a segmentation of log probability lp is among those that arrive before kappa."""
    if kappa == np.inf:
        return 0.0
    x = lp + np.log(kappa)
    return float(x if x < -30 else np.log(-np.expm1(-np.exp(x))))


def encode(docs: DataFrame, proto: bytes, k: int, id: str = "doc_id", text: str = "text", seed: int = 0, weights: str = "zipf", alpha: float = 1.0) -> DataFrame:
    """(doc_id, sample, ids, log_p, gumbel, log_inclusion, round_trip): k distinct segmentations of each text, the first arrival first.

    round_trip: whether the ids, decoded, give the text again (they do unless it holds U+2581, or a character spelt by the unknown piece).
    """

    def run(batches):
        begin()
        v = vocabulary(proto, weights, alpha)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                part = part.filter(part.column("text").is_valid())
                if not part.num_rows:
                    continue
                data, offs, _ = texts(part.column("text"))
                rows = sample_batch(v, data, offs, part.column("key").to_numpy(), k, seed)
                c = list(zip(*rows))
                off = np.concatenate([[0], np.cumsum([len(x) for x in c[5]])])
                flat = np.concatenate(c[5])
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
                whole = pa.compute.equal(pa.array(decode_ids(v, flat.astype(np.int64), off), pa.string()), part.column("text").take(pa.array(c[0])))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(c[0])), pa.array(c[1], pa.int32()), ids, pa.array(c[2]), pa.array(c[3]), pa.array(c[4]), whole], ["id", "sample", "ids", "log_p", "gumbel", "log_inclusion", "round_trip"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(id)).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, sample int, ids array<int>, log_p double, gumbel double, log_inclusion double, round_trip boolean").withColumnRenamed("id", id)


def decode_ids(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[str]:
    size = np.diff(v.bytes_at)[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    data = v.bytes[np.repeat(v.bytes_at[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
    cut = at[off].tolist()
    drop = 1 if v.dummy else 0
    return [data[i + (drop if data[i : i + 1] == b" " else 0) : j].decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:])]


def decode(samples: DataFrame, proto: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """samples with the text of their pieces in a column `out` (one of that name is replaced)."""
    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        v = vocabulary(proto)
        ok = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
        size = np.where(ok, pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False), 0)
        flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        got = decode_ids(v, flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        return pa.array([t if o else None for t, o in zip(got, ok)], pa.string())

    return samples.withColumn(out, text_of(F.col(ids)))
