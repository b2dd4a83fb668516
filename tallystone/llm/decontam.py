"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Over all documents, the occurrences of the benchmark items' words are counted.
2. A `k`-gram is the rarer, the smaller the product of its words' counts. An item's seeds are the rarer `share` of its grams, and the rarest
   in each run of `enough` words, so that a verbatim passage of so many words has one. (The
   grams' own counts would mislead: part of an item, copied often, would look common.) Where a seed stands in a document, the
   passage around it is aligned with the item: 1 for a matching word, -1 for another word and for one left out on either side.
3. A passage leaks an item of m words if its best local score is at least `least` * m or `enough` (words that
   suffice, however long the item), and at least min(m, `floor`).

The items' words are sent to the executors in groups of up to `most` bytes; each group is one more scan, so a benchmark may
have any size. No text is shuffled.

Result: (doc_id, item_id, score, similarity, start_word, end_word), one row for each passage.

Edge cases: null and empty texts on either side match nothing, as do items under `k` words; items with the same text are
each reported. Rows with a null id on either side are left out. A very long text is searched whole; repeated rows
are each reported, and of equal alignments the first. An empty table gives none. Other columns may have any names; without_leaks returns
them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import SMALL, begin, signed, texts, word_batches, words
from .shared import fresh

K, SHARE, LEAST, ENOUGH, FLOOR, MOST = 3, 0.5, 0.4, 13, 8, 1_000_000


def align(item: np.ndarray, m: np.ndarray, passage: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local scores of rows of item (m words each) and passage (n words each), and the words of the passage that they span.

    Row by row of the dynamic programme, for all pairs at once; gaps along the passage come from a running maximum.
    """
    rows, width = passage.shape
    span = np.arange(width + 1, dtype=np.int32)
    h = np.zeros((rows, width + 1), np.int32)
    since = np.broadcast_to(span, h.shape).copy()  # where the alignment that ends here began
    best, first, last = (np.zeros(rows, np.int32) for _ in range(3))
    inside = span[1:][None, :] <= n[:, None]
    for i in range(item.shape[1]):
        live = (i < m)[:, None]
        step = np.where((passage == item[:, i : i + 1]) & inside & live, 1, -1).astype(np.int32)
        down, dig = h[:, 1:] - 1, h[:, :-1] + step
        t = np.maximum(np.maximum(dig, down), 0)
        s = np.where(dig >= down, since[:, :-1], since[:, 1:])
        s = np.where(t == 0, span[1:], s)
        g = np.zeros_like(h)
        g[:, 1:] = t
        b = np.broadcast_to(span, h.shape).copy()
        b[:, 1:] = s
        lift = g + span
        run = np.maximum.accumulate(lift, axis=1)
        at = np.maximum.accumulate(np.where(lift == run, span, 0), axis=1)
        after = run - span
        b = np.where(after > g, np.take_along_axis(b, at, 1), b)
        h = np.where(live, np.maximum(after, g), h)
        since = np.where(live, b, since)
        j = h[:, 1:].argmax(1)
        top = h[np.arange(rows), j + 1]
        up = top > best
        best[up], last[up], first[up] = top[up], j[up] + 1, since[up, j[up] + 1]
    return best, first, last


class Items:
    """Words and grams of benchmark items, as the executors need them."""

    def __init__(self, ids: np.ndarray, text: list[str | None], k: int):
        w = words(*texts(pa.array(text, pa.string()))[:2])
        self.ids, self.hash, self.off, self.k = ids, w.hash, w.off, k
        at, h = w.grams(k)
        order = np.argsort(h, kind="stable")
        self.gram, self.at = h[order], at[order]
        self.owner = w.doc[self.at]

    def seeds(self, count: dict, share: float, enough: int = ENOUGH) -> "Items":
        each = np.log1p([count.get(int(h), 0) for h in signed(self.hash)])
        n = sum(each[self.at + i] for i in range(self.k)) if len(self.at) else np.zeros(0)
        keep = np.zeros(len(n), bool)
        for i in range(len(self.ids)):
            mine = np.flatnonzero(self.owner == i)
            if len(mine):
                keep[mine] = n[mine] <= np.quantile(n[mine], share, method="higher")
                mine = mine[np.argsort(self.at[mine])]
                run = max(enough - self.k + 1, 1)
                if len(mine) >= run:
                    least = np.lib.stride_tricks.sliding_window_view(n[mine], run).argmin(1)
                    keep[mine[least + np.arange(len(least))]] = True
        out = object.__new__(Items)
        out.__dict__ = self.__dict__ | {"gram": self.gram[keep], "at": self.at[keep], "owner": self.owner[keep]}
        return out


def leaks_in(w, items: Items, least: float, floor: int, enough: int = ENOUGH) -> tuple[np.ndarray, ...]:
    """(text, item, score, first word, word after the last) of leaks among the texts of w."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    at, h = w.grams(items.k)
    lo = np.searchsorted(items.gram, h)
    hit = np.flatnonzero(items.gram[np.minimum(lo, len(items.gram) - 1)] == h) if len(items.gram) else lo[:0]
    if not len(hit):
        return none
    lo = lo[hit]
    n = np.searchsorted(items.gram, h[hit], "right") - lo
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = np.repeat(at[hit], n)
    item = items.owner[which]
    doc = np.searchsorted(w.off, pos, "right") - 1
    m = np.diff(items.off)[item]
    slack = m // 4 + 8
    begin = pos - (items.at[which] - items.off[item])
    a, b = np.maximum(begin - slack, w.off[doc]), np.minimum(begin + m + slack, w.off[doc + 1])
    order = np.lexsort((a, item, doc))
    a, b, item, doc, m = a[order], b[order], item[order], doc[order], m[order]
    # passages of one item that overlap are one
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))])
    reach = np.maximum.accumulate(b + group * (len(w.hash) + 1)) - group * (len(w.hash) + 1)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (a[1:] > reach[:-1])])
    s = np.flatnonzero(new)
    a, item, doc, m = a[s], item[s], doc[s], m[s]
    b = np.maximum.reduceat(b, s)
    size = b - a
    out = []
    order = np.argsort(size * 4096 + np.minimum(m, 4095), kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * int(size[order[j]]) <= 200_000:
            j += 1
        p = order[i:j]
        i = j
        wide, tall = int(size[p].max()), int(m[p].max())
        x, y = np.arange(wide), np.arange(tall)
        passage = w.hash[np.minimum(a[p][:, None] + x, len(w.hash) - 1)]
        text = items.hash[np.minimum(items.off[item[p]][:, None] + y, len(items.hash) - 1)]
        score, first, last = align(text, m[p], passage, size[p])
        ok = ((score >= least * m[p]) | (score >= enough)) & (score >= np.minimum(m[p], floor))
        q = p[ok]
        out.append((doc[q], item[q], score[ok].astype(np.int64), a[q] + first[ok] - w.off[doc[q]], a[q] + last[ok] - w.off[doc[q]]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(5))


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, share: float = SHARE, least: float = LEAST, floor: int = FLOOR, most: int = MOST, enough: int = ENOUGH) -> DataFrame:
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    schema = f"{id} long, {item_id} long, score long, similarity double, start_word long, end_word long"
    found = None
    for group in _groups(items, k, most):
        known = np.unique(group.hash)

        def count(batches, known=known):
            begin()
            total = np.zeros(len(known), np.int64)
            for _, w in word_batches(batches, most=SMALL):
                h = w.hash
                at = np.searchsorted(known, h)
                at = at[known[np.minimum(at, len(known) - 1)] == h] if len(known) else at[:0]
                total += np.bincount(at, minlength=len(known))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(signed(known[at])), pa.array(total[at])], ["word", "n"])

        rows = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # up to `most` words
        seeds = group.seeds({r.word: r.n for r in rows}, share, enough)

        def search(batches, seeds=seeds):
            begin()
            lengths = np.diff(seeds.off)
            for part, w in word_batches(batches):
                doc, item, score, a, b = leaks_in(w, seeds, least, floor, enough)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(seeds.ids[item]), pa.array(score), pa.array(score / np.maximum(lengths[item], 1)), pa.array(a), pa.array(b)], [id, item_id, "score", "similarity", "start_word", "end_word"])

        some = docs.mapInArrow(search, schema)
        found = some if found is None else found.union(some)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _groups(items: DataFrame, k: int, most: int):
    """Items in groups of up to `most` bytes of text; only one group is on the driver at a time."""
    ids, text, size = [], [], 0
    for r in items.orderBy("id", "text").toLocalIterator():
        if ids and size + len(r.text) > most:
            yield Items(np.array(ids, np.int64), text, k)
            ids, text, size = [], [], 0
        ids.append(r.id)
        text.append(r.text)
        size += len(r.text)
    if ids:
        yield Items(np.array(ids, np.int64), text, k)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that leak an item."""
    leak = fresh(docs, "leak")
    bad = leaks(docs, benchmark, id, text).select(F.col(id).alias(leak)).distinct()
    return docs.join(bad, docs[id] == bad[leak], "left_anti")
