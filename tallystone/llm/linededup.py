"""Line deduplication by a segment-partition edit join.

Lines (between line feeds) are compared in lower case with white space squeezed, as Unicode characters. Those of
`least` characters or more match if equal, by their hashes; those of `shortest` or more also within edit distance `tau`:

1. A distinct line is cut into tau + 1 even segments. If two lines are within tau, the longer holds a segment of the shorter,
   at a place that the difference in length and the edits to either side leave open (the multi-match-aware substrings of
   Li, Deng and Feng's Pass-Join, 2011). Segments and substrings are hashed with the segment's number and the shorter length,
   and meet by hash.
2. Candidates' lines are fetched by a second scan against their sorted list in the shared folder, and verified by a banded
   bit-parallel edit distance (Hyyro, 2003), over many pairs at once.
3. Lines linked by verified pairs form groups; the first line of a group (smallest id, then line) stays.

A line is named by 63 bits of a hash of its characters. No partner is left out, however common the line.

Edge cases: null and empty texts have no lines. Rows with a null id are left out of the search and left as they are. Rows
that share an id are one document: a line of theirs that stands at one place in several rows is one line. A very long text or line is
read whole, and ties go to the smallest id, then line. An empty table gives none. remove_lines drops a document of which nothing but white
space is left. Other columns may have any names, and are returned as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .kernel import SMALL, Hasher, P, U, begin, folded, mix, signed, slices, texts
from .shared import fresh, in_lists, sorted_lists, stash

TAU, SHORTEST = 2, 24


class Lines:
    """Lines of some texts, as runs of code points: off[i]:off[i+1] of chars; doc and number of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, shortest: int):
        n = len(data)
        data = folded(data) if n else data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, bool)
        edge[0] = True
        edge[offs[(offs > 0) & (offs < n)]] = True
        edge[1:] |= data == 10
        start = np.flatnonzero(edge[:n])  # a line feed belongs to the line before
        if n:
            doc = np.searchsorted(offs, start, "right") - 1
            number = np.arange(len(start)) - np.searchsorted(start, offs[doc])
            skip = blank.copy()  # keep one blank of each run, none at a line's start or end
            skip[1:] &= blank[:-1] | edge[1:n]
            at = np.flatnonzero(~skip)
            byte = data[at]
            white = blank[at]
            byte[white] = 32
            ends = np.searchsorted(at, np.append(start[1:], n)) - 1
            ends = ends[(ends >= 0) & (at[np.maximum(ends, 0)] >= start)] if len(at) else ends[:0]
            gone = ends[white[ends]]
            if len(gone):
                byte, at = np.delete(byte, gone), np.delete(at, gone)
            first = np.flatnonzero((byte & 0xC0) != 0x80)
            cp = byte[first].astype(np.int32)
            far = np.flatnonzero(cp >= 0xC0)
            if len(far):
                b = [byte[np.minimum(first[far] + i, len(byte) - 1)].astype(np.int32) for i in range(4)]
                cp[far] = np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
            bounds = np.searchsorted(at[first], np.append(start, n))
            count = np.diff(bounds)
            use = count >= shortest
            self.chars = cp[np.repeat(use, count)]
            self.off = np.concatenate([[0], np.cumsum(count[use])])
            self.doc, self.number = doc[use], number[use]
        else:
            self.chars, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)
            self.doc = self.number = np.zeros(0, np.int64)
        self.hasher = Hasher(self.chars.astype(U) + U(1), P)
        self.key = self.hasher(self.off[:-1], self.off[1:]) & ~U(1)

    def distinct(self) -> np.ndarray:
        """One of each line, in the order of signed keys."""
        return np.unique(signed(self.key), return_index=True)[1]


def segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of these lengths; the last segments are the longer."""
    size, more = length // (tau + 1), length % (tau + 1)
    short = tau + 1 - more
    return i * size + np.maximum(i - short, 0), size + (i >= short)


def signatures(lines: Lines, which: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of segments, whose line has its last bit set, and of the other substrings that may equal one."""
    keys, names = [], []
    begin, length, name = lines.off[which], lines.off[which + 1] - lines.off[which], lines.key[which]

    def add(rows, at, size, short, i, mark):
        keys.append(mix(lines.hasher(at, at + size) ^ mix((short * 64 + i).astype(U))))
        names.append(name[rows] | U(mark))

    for i in range(tau + 1):
        at, size = segment(length, i, tau)
        add(slice(None), begin + at, size, length, i, 1)
        for less in range(tau + 1):
            short = length - less
            at, size = segment(short, i, tau)
            for shift in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1):
                if not less and not shift:
                    continue  # the segment itself
                rows = np.flatnonzero((short > tau) & (at + shift >= 0) & (at + shift + size <= length))
                add(rows, begin[rows] + at[rows] + shift, size[rows], short[rows], i, 0)
    return np.concatenate(keys), np.concatenate(names)


def within(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, tau: int) -> np.ndarray:
    """Edit distances of rows of a and b (lengths la and lb, |la - lb| <= tau <= la), tau + 1 for more: Hyyro's band in one 64-bit word."""
    one = U(1)
    rows = len(la)
    padded = np.full((rows, int(max(la.max(), lb.max())) + 3 * tau + 2), -1, np.int32)
    padded[:, tau : tau + a.shape[1]] = np.where(np.arange(a.shape[1]) < la[:, None], a, -1)
    vp = np.full(rows, (2**64 - 1) << (63 - tau) & (2**64 - 1), U)
    vn = np.zeros(rows, U)
    dist = np.full(rows, tau, np.int64)
    weights = one << np.arange(63 - 2 * tau, 64).astype(U)
    out = np.full(rows, tau + 1, np.int64)
    at = np.arange(rows)
    for j in range(int(lb.max())):
        x = ((padded[at, j : j + 2 * tau + 1] == b[at, j : j + 1]) * weights).sum(1, dtype=U)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        slope = j < la[at] - tau
        bit = np.clip(63 - (j - (la[at] - tau) + 1), 0, 63).astype(U)
        dist += np.where(slope, 1 - (d0 >> U(63)).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        end = j == lb[at] - 1
        out[at[end]] = np.minimum(dist[end], tau + 1)
        live = ~end & (dist <= 3 * tau)  # the diagonal never falls, the last row by 2 * tau at most
        if not live.all():
            at, vp, vn, dist = at[live], vp[live], vn[live], dist[live]
            if not len(at):
                break
    return out


def near_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", tau: int = TAU, shortest: int = SHORTEST) -> DataFrame:
    """(a, b, distance) of distinct lines within tau of each other, by their hashes, a < b."""
    return _search(docs, id, text, tau, shortest)[0]


def _search(docs: DataFrame, id: str, text: str, tau: int, shortest: int, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs of near_lines, and (name, doc, line) of all lines of `least` characters or more (None: of `shortest`)."""
    least = shortest if least is None else max(1, min(least, shortest))
    if tau < 1 or shortest <= 2 * tau + 2:
        raise ValueError("tau must be 1 or more, and lines longer than 2 * tau + 2")
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")

    def probes(batches):
        begin()
        for batch in batches:
            for part in slices(batch, "text", SMALL):
                lines = Lines(*texts(part.column("text"))[:2], shortest)
                if len(lines.key):
                    keys, names = signatures(lines, lines.distinct(), tau)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(signed(names))], ["key", "line"])

    def meet(batches):
        begin()
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, line = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        order = np.argsort(key)
        key, line = key[order], line[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        some = np.flatnonzero(same | np.append(same[1:], False))  # most keys are alone
        if not len(some):
            return
        key, line = key[some], line[some]
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
        key, line = key[new], line[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        marked = (line & 1).astype(bool)
        hit = (np.add.reduceat(marked.astype(np.int64), start) > 0) & (size > 1)
        for s, n in zip(start[hit].tolist(), size[hit].tolist()):
            group = line[s : s + n]
            own, other = group[marked[s : s + n]] & ~1, group & ~1
            step = max(1, (1 << 20) // len(other))
            for i in range(0, len(own), step):
                a, b = np.repeat(own[i : i + step], len(other)), np.tile(other, len(own[i : i + step]))
                ok = a != b
                if ok.any():
                    held.append((np.minimum(a, b)[ok], np.maximum(a, b)[ok]))
                if len(held) > 2048 or (held and len(held[-1][0]) > 1 << 16):
                    yield _pairs(held)
        if held:
            yield _pairs(held)

    held: list = []
    candidates = stash(docs.mapInArrow(probes, "key long, line long").repartition("key").mapInArrow(meet, "a long, b long").distinct(), "candidates")
    wanted = sorted_lists(candidates.select(F.col("a").alias("v")).union(candidates.select(F.col("b").alias("v"))).distinct(), "wanted")

    def fetch(batches):
        begin()
        for batch in batches:
            for part in slices(batch, "text", SMALL):
                lines = Lines(*texts(part.column("text"))[:2], least)
                at = lines.distinct()
                at = at[in_lists(wanted, signed(lines.key[at]))]
                chars = np.full(len(lines.key), None, object)
                for i in at.tolist():
                    chars[i] = lines.chars[lines.off[i] : lines.off[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(signed(lines.key)), part.column("id").take(pa.array(lines.doc)), pa.array(lines.number.astype(np.int32)), pa.array(chars, pa.binary())], ["name", "doc", "line", "chars"])

    places = stash(docs.mapInArrow(fetch, "name long, doc long, line int, chars binary"), "places")
    lines = places.where("chars is not null").select(F.col("name").alias("v"), "chars").dropDuplicates(["v"])
    pairs = candidates.join(lines.select(F.col("v").alias("a"), F.col("chars").alias("x")), "a").join(lines.select(F.col("v").alias("b"), F.col("chars").alias("y")), "b")

    def verify(batches):
        begin()
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            la, lb = (np.array([len(v) // 4 for v in c], np.int64) for c in (x, y))
            dist = np.full(len(x), tau + 1, np.int64)
            order = np.argsort(la, kind="stable")
            order = order[np.abs(la - lb)[order] <= tau]
            i = 0
            while i < len(order):
                j = i + 1
                while j < len(order) and (j - i + 1) * (la[order[j]] + 2 * tau) <= 1 << 20:
                    j += 1
                p = order[i:j]
                a, b = np.zeros((len(p), int(la[p].max())), np.int32), np.zeros((len(p), int(lb[p].max())), np.int32)
                for r, k in enumerate(p.tolist()):
                    a[r, : la[k]] = np.frombuffer(x[k], np.int32)
                    b[r, : lb[k]] = np.frombuffer(y[k], np.int32)
                dist[p] = within(a, la[p], b, lb[p], tau)
                i = j
            ok = np.flatnonzero(dist <= tau)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(dist[ok].astype(np.int32))], ["a", "b", "distance"])

    return pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, distance int"), places.select("name", "doc", "line")


def _pairs(held: list) -> pa.RecordBatch:
    a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    held.clear()
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", tau: int = TAU, shortest: int = SHORTEST, least: int | None = None) -> DataFrame:
    """(doc_id, line, first_doc_id, first_line, exact): each line that isn't the first of its group, and that first line."""
    pairs, places = _search(docs, id, text, tau, shortest, least)
    roots = stash(components(stash(pairs, "near-lines").select("a", "b")).withColumnRenamed("node", "name"), "line-groups")

    found = places.join(roots, "name", "left").select("name", F.coalesce("root", "name").alias("group"), "doc", "line")
    # added up within each task, so a line that stands everywhere is a row a task; most groups are one line, and end here
    place = F.struct("doc", "line", "name")
    firsts = found.groupBy("group").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("group", "first")
    again = found.join(firsts, "group").where("doc <> first.doc or line <> first.line")
    return again.select(F.col("doc").alias(id), "line", F.col("first.doc").alias(f"first_{id}"), F.col("first.line").alias("first_line"), (F.col("name") == F.col("first.name")).alias("exact"))


def remove_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars", tau: int = TAU, shortest: int = SHORTEST, least: int | None = None) -> DataFrame:
    """docs without their repeated lines; `chars`, if docs has it, becomes the new length. Documents left blank go."""
    key, gone = fresh(docs, "key", "gone")
    again = repeated_lines(docs, id, text, tau, shortest, least).groupBy(F.col(id).alias(key)).agg(F.collect_set("line").alias(gone))
    both = docs.join(again, docs[id] == again[key], "left")
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    out = both.withColumn(text, new).where(F.col(gone).isNull() | F.col(text).rlike(r"[^\s\p{Z}\p{Cc}]"))
    if chars in docs.columns:
        out = out.withColumn(chars, F.when(F.col(gone).isNull(), F.col(chars)).otherwise(F.length(text).cast(docs.schema[chars].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
