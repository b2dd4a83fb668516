"""Passages that documents share, by suffix arrays of shards and a merge across shards.

Suffixes are ordered by the 64-bit hashes of their words, an order that every shard shares. A passage counts
if at least `least` words in a row stand in two documents. Steps:

1. Each window of `least` words has an anchor, the smallest hash of the `least // 2 + 1`-grams within it, so equal
   windows have equal anchors, and neighbouring windows mostly the same one. Anchors seen in one document only rule
   their windows out; this loses nothing.
2. Documents with a shared anchor are sharded by their smallest such anchor, which brings copies together. In each
   shard (of up to `shard` bytes) Larsson-Sadakane refinement gives the suffix array, Kasai's method the common
   prefixes, and runs of the array with common prefixes of `least` words the shard's shared windows.
3. One suffix of each run, and those that are alone in their shard, go on, with the windows' hashes, by anchor to
   the merge, which regroups the hashes; no suffix is searched in another shard's array. Exact but for hash collisions.

Result: (doc_id, start_word, end_word, first), the maximal runs of words covered by shared windows; `first` holds for
windows that are the first of their kind (smallest id, then position), the others are repeats.

Edge cases: null and empty texts, and those under `least` words, have no windows. Rows with a null id are left out, rows
that share an id are one document, and passages that one document repeats by itself don't count. A very long text is a shard by
itself. Ties go to the smallest id, then position. An empty table gives none. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .kernel import Q, U, Words, signed, window_hash, word_batches
from .shared import stash

LEAST, SHARD = 50, 3 << 20


def suffix_array(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of non-negative integers under 2**31 (Larsson-Sadakane: only groups not yet apart are sorted again)."""
    n = len(r)
    nxt = np.concatenate([r[1:] + 1, [0]]) if n else r
    key = r.astype(np.int64) << 32 | nxt
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    head = np.ones(n, bool)
    head[1:] = k[1:] != k[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    h = 2
    while True:
        alone = head & np.concatenate([head[1:], [True]]) if n else head
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa, rank
        s = sa[at]
        follow = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
        key = rank[s] << 32 | follow
        order = np.argsort(key, kind="stable")
        sa[at] = s[order]
        k = key[order]
        head[at] = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.maximum.accumulate(np.where(head[at], at, 0))
        rank[sa[at]] = first
        h *= 2


def common_prefixes(values: np.ndarray, sa: np.ndarray, rank: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """By array position, words shared with the suffix before (Kasai's method).

    The text is cut into lanes that go forward together; each keeps its prefix length less one from a suffix to
    the next, as Kasai does, and lengthens it by doubling strides whose hashes are compared.
    """
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    step = -(-n // lanes)
    pos = np.arange(0, n, step)
    stop = np.minimum(pos + step, n)
    h = np.zeros(len(pos), np.int64)
    stride = np.ones(len(pos), np.int64)
    out = np.zeros(n, np.int64)
    while len(pos):
        j = before[pos]
        a, b = pos + h, j + h
        fits = (j >= 0) & (np.maximum(a, b) + stride <= n)
        long = fits & (stride > 1)
        same = fits & (values[np.minimum(a, n - 1)] == values[np.minimum(np.maximum(b, 0), n - 1)])
        at = np.flatnonzero(long & same)
        if len(at):
            s = stride[at]
            same[at] = _equal(values, a[at], b[at], s)
        h = np.where(same, h + stride, h)
        done = ~same & (stride == 1)
        out[pos[done]] = h[done]
        stride = np.where(same, stride * 2, 1)
        pos = pos + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        live = pos < stop
        if not live.all():
            pos, stop, h, stride = pos[live], stop[live], h[live], stride[live]
    lcp[rank] = out
    return lcp


def _equal(values: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether values[a:a+s] equal values[b:b+s]; elements themselves are compared."""
    first = np.concatenate([[0], np.cumsum(s)])
    inner = np.arange(first[-1]) - np.repeat(first[:-1], s)
    return np.logical_and.reduceat(values[np.repeat(a, s) + inner] == values[np.repeat(b, s) + inner], first[:-1])


def _anchors(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, their anchors, and the text of each."""
    n = w.off[-1]
    k = least // 2 + 1
    doc = w.doc
    at = np.flatnonzero(np.arange(n) + least <= w.off[1:][doc]) if n else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, U), at
    i = np.arange(n - k + 1)
    m = window_hash(w.hash, i, i + k, Q)
    span, width = least - k + 1, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if span > width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    return at, m[at], doc[at]


def _runs(at: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Starts of runs of consecutive positions that agree in all of by."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def shard_rows(w: Words, ids: np.ndarray, least: int, wanted: np.ndarray | None = None) -> list[tuple]:
    """(anchor, doc, start, n, hashes, several) of windows for the merge, and those with anchor None that are repeats already."""
    at, anchor, doc = _anchors(w, least)
    if not len(at):
        return []
    # words and, after each text, an end that differs from all else
    texts = len(w.off) - 1
    uniq, r = np.unique(w.hash, return_inverse=True)
    where = np.arange(len(w.hash)) + w.doc
    seq = np.empty(len(w.hash) + texts, np.int64)
    seq[where] = r + texts
    seq[w.off[1:] + np.arange(texts)] = np.arange(texts)
    sa, rank = suffix_array(seq)
    lcp = common_prefixes(seq, sa, rank)
    window = np.full(len(seq), -1)
    window[where[at]] = np.arange(len(at))
    in_order = window[sa]
    run = np.cumsum(lcp < least)
    keep = in_order >= 0
    win, run = in_order[keep], run[keep]
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    owner = ids[doc[win]]
    many = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
    size = np.diff(np.concatenate([start, [len(win)]]))
    many = np.repeat(many, size)
    local = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((at[win], owner, local))
    lead = np.zeros(len(win), bool)
    lead[order[start]] = True  # the first of each run
    several = np.zeros(len(at), bool)
    several[win] = many
    repeat = np.zeros(len(at), bool)
    repeat[win] = many & ~lead
    out = []
    hashes = window_hash(w.hash, at, at + least, Q)
    rel = at - w.off[doc]
    x = np.flatnonzero(repeat)
    for i, j in _spans(_runs(at[x], doc[x]), len(x)):
        out.append((None, int(ids[doc[x[i]]]), int(rel[x[i]]), j - i, None, None))
    on = ~repeat if wanted is None else ~repeat & np.isin(anchor, wanted)
    x = np.flatnonzero(on)
    for i, j in _spans(_runs(at[x], doc[x], anchor[x]), len(x)):
        p = x[i:j]
        out.append((int(signed(anchor[p[:1]])[0]), int(ids[doc[p[0]]]), int(rel[p[0]]), j - i, hashes[p].tobytes(), several[p].tobytes()))
    return out


def _spans(starts: np.ndarray, n: int):
    s = starts.tolist()
    return zip(s, [*s[1:], n])


ROWS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])
ROWS_SQL = "anchor long, doc long, start int, n int, hashes binary, several binary"


def merge_rows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, hashes: list[bytes], several: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, start, words covered less the window, first) of windows that two documents share."""
    h = np.frombuffer(b"".join(hashes), U)
    many = np.frombuffer(b"".join(several), bool)
    row = np.repeat(np.arange(len(doc)), n)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + start[row]
    owner = doc[row]
    order = np.lexsort((pos, owner, h))
    s = h[order]
    keys = np.unique(s)
    lo, hi = np.searchsorted(s, keys), np.searchsorted(s, keys, "right")
    shared = (owner[order[lo]] != owner[order[hi - 1]]) | np.logical_or.reduceat(many[order], lo) if len(s) else np.zeros(0, bool)
    hit = np.zeros(len(h), bool)
    hit[order] = np.repeat(shared, hi - lo)
    first = np.zeros(len(h), bool)
    first[order[lo]] = True
    x = np.flatnonzero(hit)
    runs = _runs(pos[x], row[x], first[x])
    size = np.diff(np.concatenate([runs, [len(x)]]))
    return owner[x[runs]], pos[x[runs]], size, first[x[runs]]


def shared_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, shard: int = SHARD) -> DataFrame:
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    def anchors(batches):
        for rows, w in word_batches(batches):
            at, anchor, doc = _anchors(w, least)
            i = _runs(at, anchor, doc)
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[i])), rows.column("id").take(pa.array(doc[i]))], ["anchor", "doc"])

    def repeated(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        a, d = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        o = np.lexsort((d, a))
        a, d = a[o], d[o]
        s = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        if not len(s):
            return
        size = np.diff(np.concatenate([s, [len(a)]]))
        keep = np.repeat(d[s] != d[s + size - 1], size)
        keep[1:] &= (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(a[keep])], ["doc", "anchor"])

    seen = docs.mapInArrow(anchors, "anchor long, doc long").repartition("anchor").mapInArrow(repeated, "doc long, anchor long")
    wanted = seen.groupBy("doc").agg(F.collect_set("anchor").alias("anchors"), F.min("anchor").alias("route"))

    def sorted_shards(batches):
        for rows, w in word_batches(batches, most=shard):
            flat = rows.column("anchors").flatten().to_numpy(zero_copy_only=False)
            out = shard_rows(w, rows.column("id").to_numpy(), least, np.unique(flat).view(U))
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 50_000]), ROWS)], schema=ROWS)

    def merged(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        doc, start, n = (t.column(c).to_numpy() for c in ("doc", "start", "n"))
        d, s, k, f = merge_rows(doc, start, n, t.column("hashes").to_pylist(), t.column("several").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(s + k - 1 + least), pa.array(f)], ["doc", "a", "b", "first"])

    involved = docs.join(wanted, docs["id"] == wanted["doc"]).select("id", "text", "anchors", "route").repartition("route").select("id", "text", "anchors")
    lists = stash(involved.mapInArrow(sorted_shards, ROWS_SQL), "suffixes")
    here = lists.where("anchor is null").select("doc", F.col("start").cast("long").alias("a"), (F.col("start").cast("long") + F.col("n") - 1 + least).alias("b"), F.lit(False).alias("first"))
    there = lists.where("anchor is not null").repartition("anchor").mapInArrow(merged, "doc long, a long, b long, first boolean")
    by = Window.partitionBy("doc", "first").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    pieces = here.union(there).withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("k", F.sum("new").over(by))
    return pieces.groupBy("doc", "first", "k").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(F.col("doc").alias(id), F.col("a").alias("start_word"), F.col("b").alias("end_word"), "first")
