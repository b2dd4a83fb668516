"""SimHash near-duplicates by masks that no near pair escapes, and vantage-point trees.

A document's fingerprint is the 128-bit SimHash of its word bigrams. Two documents are near copies if
their fingerprints differ in at most `radius` bits. A `ratio` may bound the factor of their word counts too (by default nothing does).

Unrelated fingerprints lie so evenly that a triangle inequality rules out none of them, so pairs are not sought by distance but by agreement.
A fingerprint is cut in parts so that any two within the radius differ in few bits of one part (`parts_of`); for so few bits,
whichever they are, one of the part's `masks` leaves them all out. So all pairs within the radius agree under some mask, and of others few do.
For each mask, rows are sorted by what it leaves and those that agree are compared; where many do, by a vantage-point tree (`dense`).
The pairs are exact, and each is told by the first of its masks only.

Fingerprints lie in mapped files in the shared folder; a task takes some masks, and of more than `shard` rows those whose keys have its
remainder. More parts mean fewer masks and more rows that agree by chance: a sample decides, which shapes the work and never the result.

Edge cases: a null or empty text, or one without words, has no fingerprint and is in a group by itself. Rows
that share an id are one document. Rows with a null id are each by themselves. Equal fingerprints are
collapsed first, so thousands of copies cost one query. Ties go to the smallest id. A very long text is read whole. An empty
table gives none. Other columns may have any names; keep_one returns them as they are.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .kernel import SMALL, Words, begin, mix, signed, word_batches
from .shared import fresh, map_blob, new_path, stash, write_blob

U = np.uint64
RADIUS, RATIO = 26, np.inf
SHARD, SAMPLE, LEAF, WIDE = 1 << 20, 20_000, 512, 64
#: Errors of a part; comparisons that cost as much as a row sorted; rows sorted in a task; an odd number that spreads bits upwards.
MOST, PAIR, TASK, ODD = 9, 0.15, 5e6, U(0x9E3779B97F4A7C15)


def fingerprints_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, high and low 64 bits) of the texts that have words."""
    count = np.diff(w.off)
    at, h = w.grams(2)
    one = np.flatnonzero(count == 1)  # a single word is its own feature
    at, h = np.concatenate([at, w.off[one]]), np.concatenate([h, w.hash[w.off[one]]])
    order = np.argsort(at, kind="stable")
    h = h[order]
    docs = np.flatnonzero(count > 0)
    n = np.maximum(count[docs] - 1, 1)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty((len(docs), 2), U)
    step = 1 << 16
    votes = np.zeros((len(docs), 128), np.int32)
    for i in range(0, len(h), step):
        part = h[i : i + step]
        bits = np.unpackbits(np.stack([part, mix(part + U(1))], 1).view(np.uint8), axis=1)
        lo, hi = np.searchsorted(first, i, "right") - 1, np.searchsorted(first, i + len(part), "left")
        cuts = np.maximum(first[lo:hi] - i, 0)
        votes[lo:hi] += 2 * np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        new = np.flatnonzero(first[lo:hi] >= i)
        votes[lo + new] += bits[cuts[new]]  # ties fall as the first bigram's bit, so that short texts' bits are even too
    out[:] = np.packbits(votes > n[:, None], axis=1).view(U) if len(docs) else out
    return docs, out[:, 0], out[:, 1]


def _prints(batches):
    begin()
    for rows, w in word_batches(batches, most=SMALL):
        docs, hi, lo = fingerprints_of(w)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(docs)), pa.array(np.diff(w.off)[docs]), pa.array(signed(hi)), pa.array(signed(lo))], ["id", "n", "hi", "lo"])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n words, hi, lo) of the documents that have words."""
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").mapInArrow(_prints, "id long, n long, hi long, lo long")


def parts_of(t: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, errors) of t parts of a fingerprint: any two within the radius differ in at most that many bits of one part at least."""
    cuts = [(128 * i // t, (radius + 1) * i // t) for i in range(t + 1)]
    return [(a, b - a, y - x - 1) for (a, x), (b, y) in zip(cuts, cuts[1:])]


@lru_cache(32)
def masks(bits: int, errors: int) -> np.ndarray:
    """Masks of a part, 2**(errors + 1) - 1: whichever `errors` bits are changed, one mask at least holds none of them.

    Each bit has a vector of errors + 1 bits, and the mask of a vector v has the bits whose vectors have an odd product with v (Pagh, 2016):
    `errors` vectors don't span the space, so some v is orthogonal to all. The vectors are those for which the fewest unlike words agree.
    """
    if errors < 0:
        return np.zeros(0, U)
    v = np.arange(1 << errors + 1)
    odd = np.bitwise_count(v[:, None] & v) & 1
    share = np.where(odd, 0.5, 1.0)
    vectors, alike = np.zeros(bits, np.int64), np.ones(len(v))
    for _ in range(4):
        for i in range(bits):
            alike /= share[vectors[i]]
            vectors[i] = np.argmin(share[:, 1:] @ alike[1:])
            alike *= share[vectors[i]]
    return np.bitwise_or.reduce(odd[vectors, 1:].astype(U) << np.arange(bits, dtype=U)[:, None], axis=0)


def word(hi: np.ndarray, lo: np.ndarray, first: int, bits: int) -> np.ndarray:
    """So many bits of fingerprints, up to 64."""
    w = hi >> U(first - 64) if first >= 64 else lo >> U(first) | hi << U(64 - first) if first else lo
    return w & U((1 << bits) - 1)


def dense(hi: np.ndarray, lo: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, later row, bits) of all pairs within the radius, by a vantage-point tree down to leaves."""
    found: list = []
    rng = np.random.default_rng(11)

    def far(at: np.ndarray, v: int) -> np.ndarray:
        return np.bitwise_count(hi[at] ^ hi[v]).astype(np.int16) + np.bitwise_count(lo[at] ^ lo[v])

    def compare(h: np.ndarray, q: np.ndarray) -> None:
        """All of h with all of q, in tiles that stay in a core's cache."""
        for i in range(0, len(h), 32):
            b = h[i : i + 32]
            for j in range(0, len(q), 2048):
                c = q[j : j + 2048]
                d = np.bitwise_count(hi[b, None] ^ hi[c])
                d += np.bitwise_count(lo[b, None] ^ lo[c])
                d[b[:, None] >= c] = 255  # a pair is taken once
                x, y = np.nonzero(d <= radius)
                if len(x):
                    found.append((b[x], c[y], d[x, y].astype(np.int32)))

    def search(h: np.ndarray, q: np.ndarray, tries: int) -> None:
        if not len(h) or not len(q):
            return
        if len(h) <= LEAF or not tries:
            return compare(h, q)
        best = None
        for v in rng.choice(h, 3):
            dh, dq = far(h, v), far(q, v)
            split = np.median(dh)
            cost = (dh < split).sum() * (dq - radius < split).sum() + (dh >= split).sum() * (dq + radius >= split).sum()
            if best is None or cost < best[0]:
                best = cost, dh < split, dq - radius < split, dq + radius >= split
        cost, left, ql, qr = best
        if cost > 0.95 * len(h) * len(q) or not 0 < left.sum() < len(h):
            return compare(h, q)  # these bounds prune nothing
        search(h[left], q[ql], tries - 1)
        search(h[~left], q[qr], tries - 1)

    search(np.arange(len(hi)), np.arange(len(hi)), 40)
    return found


def agreeing(hi: np.ndarray, lo: np.ndarray, key: np.ndarray, radius: int, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, bits) of the pairs within the radius whose keys agree; pairs are compared whole, so a key may lose its low bits."""
    m = len(key)
    low = U((1 << max(1, (m - 1).bit_length())) - 1)
    key = key & ~low | np.arange(m, dtype=U)
    key.sort()
    order = (key & low).astype(np.int64)
    key &= ~low
    hi, lo = hi[order], lo[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    size = np.diff(last, prepend=-1)
    big = np.flatnonzero(size > wide)
    at = np.arange(m) if not len(big) else np.flatnonzero(np.repeat(size <= wide, size))
    found, step = [], 0
    while len(at):  # each row with the one that stands so many places on
        step += 1
        at = at[: np.searchsorted(at, m - step)]
        at = at[key[at] == key[at + step]]
        d = np.bitwise_count(hi[at] ^ hi[at + step])
        d += np.bitwise_count(lo[at] ^ lo[at + step])
        near = np.flatnonzero(d <= radius)
        found.append((order[at[near]], order[at[near] + step], d[near].astype(np.int32)))
    for i, n in zip((last[big] + 1 - size[big]).tolist(), size[big].tolist()):
        found += [(order[i + x], order[i + y], d) for x, y, d in dense(hi[i : i + n], lo[i : i + n], radius)]
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.int32)))


def plan(hi: np.ndarray, lo: np.ndarray, total: int, radius: int) -> tuple[list[tuple[int, int, int]], list[np.ndarray], float]:
    """Parts, their masks, and the work in rows sorted: the number of parts that a sample makes cheapest. It never shapes the result."""
    best = None
    for t in range(2, 17):
        parts = parts_of(t, radius)
        if max(e for *_, e in parts) > MOST:
            continue
        own = [masks(bits, e) for _, bits, e in parts]
        every = [(k, v) for k, m in enumerate(own) for v in m]
        some = every[:: max(1, len(every) // 24)]
        pairs = 0
        for k, v in some:
            n = np.unique(word(hi, lo, *parts[k][:2]) & v, return_counts=True)[1]
            pairs += int((n * (n - 1) // 2).sum())
        pairs *= len(every) / len(some) * (total / max(len(hi), 1)) ** 2
        cost = len(every) * (total + 1e3) + PAIR * pairs
        if best is None or cost < best[2]:
            best = parts, own, cost
    return best


def near_pairs(prints: DataFrame, radius: int = RADIUS, ratio: float = RATIO, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """All pairs (a, b, bits), a < b, within the radius, of fingerprints (id, n, hi, lo), each pair of rows once; `shard` rows are compared at once."""
    spark = prints.sparkSession
    path = new_path(spark, "prints")

    def save(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            to = f"{path}/{uuid.uuid4().hex}"
            write_blob(to, b"".join(t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("hi", "lo", "n", "id")))
            yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([t.num_rows])], ["path", "rows"])

    files = [(r.path, r.rows) for r in prints.select("id", "n", "hi", "lo").mapInArrow(save, "path string, rows long").collect()]  # a row a partition
    first = np.cumsum([0, *(n for _, n in files)])
    total = int(first[-1])
    part = prints.where(F.xxhash64("hi", "lo", "n", F.lit(3)) / 2.0**64 + 0.5 < sample / max(total, 1)).select("hi", "lo").toPandas()
    parts, own, cost = plan(part["hi"].to_numpy(np.int64).view(U), part["lo"].to_numpy(np.int64).view(U), total, radius)
    turns = max(1, -(-total // shard))
    every = [(k, v, turn) for k, m in enumerate(own) for v in range(len(m)) for turn in range(turns)]
    limit = np.log(ratio) + 1e-9

    def columns(i: int) -> np.ndarray:
        return map_blob(files[i][0]).view(np.int64).reshape(4, -1)

    def looked_up(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word counts and ids."""
        n, id = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        of = np.searchsorted(first, rows, "right") - 1
        for i in np.unique(of):
            at = np.flatnonzero(of == i)
            n[at], id[at] = columns(i)[2:, rows[at] - first[i]]
        return n, id

    def within(batches):
        begin()
        whole = None
        for k, v, turn in (every[i] for b in batches for i in b.column(0).to_pylist()):
            at, bits, errors = parts[k]
            keyed = lambda hi, lo: (word(hi, lo, at, bits) & own[k][v]) * ODD
            if turns == 1:
                if whole is None:
                    whole = [np.concatenate([columns(i)[c] for i in range(len(files))]).view(U) for c in (0, 1)]
                hi, lo = whole
                row, key = None, keyed(hi, lo)
            else:
                got = []
                for i in range(len(files)):
                    hi, lo = columns(i)[:2].view(U)
                    key = keyed(hi, lo)
                    use = np.flatnonzero((key >> U(32)) % U(turns) == U(turn))
                    got.append((hi[use], lo[use], use + first[i], key[use]))
                hi, lo, row, key = (np.concatenate([g[c] for g in got]) for c in range(4))
            if not len(key):
                continue
            x, y, d = agreeing(hi, lo, key, radius)
            # a pair belongs to the first part in which it has few errors, and there to the first mask that holds none of them
            other = word(hi[x] ^ hi[y], lo[x] ^ lo[y], at, bits)
            keep = np.bitwise_count(other) <= errors
            for a, b, e in parts[:k]:
                keep &= np.bitwise_count(word(hi[x] ^ hi[y], lo[x] ^ lo[y], a, b)) > (e if e >= 0 else -1)
            keep = np.flatnonzero(keep)
            for u in own[k][:v]:
                if not len(keep):
                    break
                keep = keep[other[keep] & u != 0]
            if len(keep):
                x, y = (x[keep], y[keep]) if row is None else (row[x[keep]], row[y[keep]])
                (n, a), (m, b) = looked_up(x), looked_up(y)
                ok = (a != b) & (np.abs(np.log(n) - np.log(m)) <= limit)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(d[keep][ok])], ["a", "b", "bits"])

    tasks = min(len(every), max(1, int(cost // TASK)))
    return spark.range(0, len(every) if total else 0, 1, tasks).mapInArrow(within, "a long, b long, bits int")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, ratio: float = RATIO, shard: int = SHARD) -> DataFrame:
    """(id, group_id, group_size) of every document in a group of two or more; group_id is its smallest id."""
    all_prints = stash(fingerprints(docs, id, text).distinct(), "prints")
    one = stash(all_prints.groupBy("hi", "lo", "n").agg(F.min("id").alias("id")), "distinct-prints")
    same = all_prints.join(one.withColumnRenamed("id", "a"), ["hi", "lo", "n"]).where("id <> a").select("a", F.col("id").alias("b"))
    near = near_pairs(one, radius, ratio, shard).select("a", "b")
    groups = stash(components(near.union(same)), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("group_size"))
    return groups.join(sizes, "root").select(F.col("node").alias(id), F.col("root").alias("group_id"), "group_size")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """docs without all but the smallest id of each group; of rows that share an id, one stays."""
    drop = fresh(docs, "drop")
    extra = near_groups(docs, id, text, radius, ratio).where(F.col(id) != F.col("group_id")).select(F.col(id).alias(drop))
    kept = docs.join(extra, docs[id] == extra[drop], "left_anti")
    has, none = kept.where(F.col(id).isNotNull()), kept.where(F.col(id).isNull())
    again = stash(docs.where(F.col(id).isNotNull()).groupBy(F.col(id).alias(drop)).count().where("count > 1").select(drop), "repeated")
    if again.isEmpty():
        return kept
    single = has.join(again, has[id] == again[drop], "left_anti")
    return single.unionByName(has.join(again, has[id] == again[drop], "left_semi").dropDuplicates([id])).unionByName(none)
