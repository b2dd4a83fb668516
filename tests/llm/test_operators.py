"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import audio, components, decontam, eftrie, kernel, lattice, licences, linededup, ngrams, quality, sharding, simhash, suffix
from tallystone.llm.entries import model_proto

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, text2 string, n int, shard string, model string, a int, b int, key string, line string"


def frame(spark, rows):
    """Documents, with columns whose names the operators use within."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "z", 1, "x", "m", 1, 2, "k", "l") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def of(texts_):
    return kernel.words(*kernel.texts(pa.array(texts_, pa.string()))[:2])


# ---- the kernel

def test_words():
    w = of(["Hello, WORLD é", None, "", "日本a b", "x"])
    assert np.diff(w.off).tolist() == [3, 0, 0, 4, 1]
    assert of(["hello"]).hash[0] == w.hash[0] and of(["É"]).hash[0] == w.hash[2]
    at, h = of(["a b c", "a b"]).grams(2)
    assert len(at) == 3 and h[0] == h[2] and h[0] != h[1]
    assert sum(p.num_rows for p in kernel.slices(pa.RecordBatch.from_pydict({"text": ["aaaa", None, "b" * 99, "", "cc"]}), "text", 5)) == 5


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (7, 7), (8, 5), (20, 30), (30, 40), (40, 50), (50, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 5, 8: 5, 5: 5, **dict.fromkeys((20, 30, 40, 50, 60), 20)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 audio

def ima(data, block):
    out = []
    for i in range(0, len(data), block):
        b = data[i : i + block]
        if len(b) < 4:
            continue
        p, k = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(p)
        for c in (x for byte in b[4:] for x in (byte & 15, byte >> 4)):
            s = int(audio.STEPS[k])
            d = (s >> 3) + (s if c & 4 else 0) + (s >> 1 if c & 2 else 0) + (s >> 2 if c & 1 else 0)
            p = max(-32768, min(32767, p - d if c & 8 else p + d))
            k = max(0, min(88, k + int(audio.MOVES[c & 7])))
            out.append(p)
    return out


def test_adpcm_and_tables():
    rng = np.random.default_rng(0)
    recs = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 3, 4, 5, 255, 256, 257, 259, 260, 1000)]
    off = np.concatenate([[0], np.cumsum([len(r) for r in recs])])
    pcm, o = audio.adpcm(np.concatenate(recs), off)
    assert all(pcm[o[i] : o[i + 1]].tolist() == ima(bytes(r), 256) for i, r in enumerate(recs))
    mu, a = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)


@pytest.mark.parametrize("rate,target", [(8000, 16000), (8000, 22050), (16000, 8000)])
def test_resample(rate, target):
    rng = np.random.default_rng(1)
    recs = [rng.integers(-20000, 20000, n).astype(np.int16) for n in (0, 1, 5, 90)]
    off = np.concatenate([[0], np.cumsum([len(r) for r in recs])])
    y, to = audio.resample(np.concatenate(recs), off, rate, target)
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    h = audio._filters(up, down, max(16, 2 * -(-16 * down // (2 * up))) if down > up else 16)
    taps = h.shape[1]
    for i, r in enumerate(recs):
        want = []
        for m in range(-(-len(r) * up // down)):
            f, p = divmod(m * down, up)
            want.append(sum(float(h[p, j]) * int(r[k]) for j in range(taps) if 0 <= (k := f + j - (taps // 2 - 1)) < len(r)))
        assert len(want) == to[i + 1] - to[i] and np.allclose(y[to[i] : to[i + 1]], np.clip(np.rint(want), -32768, 32767), atol=1)


def test_audio_edges(spark):
    rows = [(1, b"\xff\x00", "mulaw", 8000), (1, b"\xff\x00", "mulaw", 8000), (2, None, "alaw", 8000), (3, b"", "adpcm", 8000), (4, b"ab", "mp3", 8000), (5, b"ab", "alaw", 0), (6, b"ab", None, 8000), (None, b"ab" * 90_000, "alaw", 16000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, payload binary, codec string, rate int, pcm string, n_samples int")
    got = audio.decode_audio(df, "doc_id").collect()
    assert len(got) == 8 and [r.n_samples for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [4, 4, None, 0, None, None, None, 180_000]
    assert audio.decode_audio(df.limit(0), "doc_id").count() == 0


# ---- 2 segmentations

@pytest.fixture(scope="module")
def proto():
    return model_proto()


def test_sampling_is_without_replacement(proto):
    v = lattice.vocabulary(proto)
    text, n, k = "ab cat", 6000, 3
    rows = lattice.sample_batch(v, *kernel.texts(pa.array([text] * n))[:2], np.arange(n), k, 1)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s = "▁ab▁cat"

    def paths(i):
        if i == len(s):
            return [((), 0.0)]
        return [((ids[s[i:j]], *p), w + v.weight[ids[s[i:j]]]) for j in range(i + 1, len(s) + 1) if s[i:j] in ids for p, w in paths(j)]

    every = paths(0)
    z = np.logaddexp.reduce([w for _, w in every])
    prob = {p: math.exp(w - z) for p, w in every}
    by = collections.defaultdict(list)
    for d, _, lp, _, inc, x in rows:
        assert math.isclose(math.exp(lp), prob[tuple(x)], rel_tol=1e-9)
        by[d].append((tuple(x), lp, inc))
    assert all(len({x for x, _, _ in r}) == k for r in by.values())
    for rank, want in ((0, prob), (1, {p: sum(prob[q] * prob[p] / (1 - prob[q]) for q in prob if q != p) for p in prob})):
        got = collections.Counter(r[rank][0] for r in by.values())
        assert all(abs(got[p] / n - want[p]) < 4 * math.sqrt(want[p] * (1 - want[p]) / n) + 1e-3 for p in prob)
    # weighted by inclusion, the samples' probabilities add up to 1
    assert abs(np.mean([sum(math.exp(lp - inc) for _, lp, inc in r) for r in by.values()]) - 1) < 1e-3


def test_encoding_edges(spark, proto):
    long = "wordy é日本 \n" * 4000
    rows = [(1, "hello  world"), (1, "hello  world"), (2, None), (3, ""), (None, "x🎉y"), (4, long), (5, "a" * 3000), (6, " lead\ttab▁"), (7, "\x00\x7f")]
    got = lattice.encode(frame(spark, rows), proto, k=3, seed=5).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert 2 not in by and len(by[3]) == 1 and by[3][0].ids == [] and len(by[1]) == 6 and len(by[4]) == 3
    assert [r.ids for r in by[1][:3]] == [r.ids for r in by[1][3:]]
    assert all(r.round_trip for i, x in by.items() for r in x if i != 6) and not by[6][0].round_trip
    assert all(r.log_p <= 1e-9 and r.log_inclusion <= 1e-9 for r in got)
    again = {(r.doc_id, r.sample): r.ids for r in lattice.encode(frame(spark, rows[::-1]).repartition(3), proto, k=3, seed=5).collect()}
    assert again == {(r.doc_id, r.sample): r.ids for r in got}
    back = lattice.decode(spark.createDataFrame([(by[1][0].ids, "old"), (None, "old"), ([], "old")], "ids array<int>, text string"), proto).collect()
    assert [r.text for r in back] == ["hello  world", None, ""]
    assert lattice.encode(empty(spark), proto, k=2).count() == 0


# ---- 3 licences

@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    return licences.Classifier([words(rng, rng.randrange(3, 40)) for _ in range(1500)])


def test_licences(spark, model):
    assert model.accuracy > 0.95  # held out
    rng = random.Random(4)
    rows = [(1, "code\nReleased under the MIT License.\n" + words(rng, 50)), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."), (4, "Licensed under the Apache License, Version 2.0."), (None, "Licensed under CC BY-NC 4.0."), (5, words(rng, 30_000)), (6, "\n".join(licences.PROSE))]
    got = licences.licences(frame(spark, rows), model).collect()
    assert sorted((r.doc_id or 0, r.line, r.family, r.confirmed) for r in got) == [(0, 0, "cc-by-nc", True), (1, 1, "mit", True), (4, 0, "apache", True), (4, 0, "apache", True)]
    assert licences.licences(empty(spark), licences.train(empty(spark))).count() == 0


def test_short_licence_lines(spark, model):
    rng = random.Random(41)
    titles = {"All rights reserved.": "proprietary", "ALL RIGHTS RESERVED": "proprietary", "MIT License": "mit", "BSD License": "bsd", "Apache License": "apache", "Mozilla Public License": "mpl", "GNU General Public License": "gpl", "GNU Lesser General Public License": "lgpl"}
    other = ["license", "All", "rights", "reserved", "Public", "w1", "w5 w7", "w3 w9 w2", "", "?!", "The license"]
    rows = [(i, f"{words(rng, 30)}\n{t}\n{words(rng, 30)}") for i, t in enumerate([*titles, *other])]
    got = licences.licences(frame(spark, rows), model).collect()
    assert sorted((r.doc_id, r.line, r.family) for r in got if r.confirmed) == [(i, 1, f) for i, f in enumerate(titles.values())]
    assert {r.doc_id for r in got if not r.confirmed} <= set(range(len(titles), len(rows)))


def test_altered_templates(model):
    rng = np.random.default_rng(9)
    hits = total = 0
    for f, some in licences.TEMPLATES.items():
        for t in (t for t in some if len(t.split()) > 12):
            for _ in range(5):
                w = t.split()
                del w[int(rng.integers(len(w)))]
                found = model.scan(licences._of([" ".join(w)]))
                total += 1
                hits += len(found[0]) == 1 and model.families[found[1][0]] == f and bool(found[4][0])
    assert hits > 0.9 * total


# ---- 4 and 9: n-grams

def brute_kn(corpus, n):
    c = collections.Counter()
    for t in corpus:
        b = b"\n" * (n - 1) + t.encode()
        c.update(b[j - n + 1 : j + 1] for j in range(n - 1, len(b)))
    a = {n: c}
    for k in range(n - 1, 0, -1):
        a[k] = collections.Counter(g[1:] for g in a[k + 1])
    d = {k: ngrams.discounts(*(sum(v == i for v in a[k].values()) for i in (1, 2, 3, 4))) for k in a}

    def p(g):
        if not g:
            return 1 / 256
        row = {h: x for h, x in a[len(g)].items() if h[:-1] == g[:-1]}
        if not row:
            return p(g[1:])
        cut = lambda x: d[len(g)][min(x, 3) - 1]
        return (max(row[g] - cut(row[g]), 0) if g in row else 0) / sum(row.values()) + sum(map(cut, row.values())) / sum(row.values()) * p(g[1:])

    return p


CORPUS = ["the cat sat on the mat", "the dog sat", "a cat and a dog é", "mat on cat", "zebra the end", ""]


def test_kneser_ney_and_trie(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id long, text string")
    p = brute_kn(CORPUS, ngrams.N)
    ask = [b"the c", b"\n\n\n\nt", b"zzzzz", b" cat ", b"q\xc3\xa9ab", b"e mat", b"d dog", b"the z"]
    g = np.sort([int.from_bytes(x, "big") for x in ask])
    want = np.log([p(int(x).to_bytes(5, "big")) for x in g])
    for each in (1 << 20, 20):  # one shard and several
        m = eftrie.train(df, each=each)
        assert (m.shards > 1) == (each == 20) and np.abs(m.logp(g) - want).max() < 0.03  # quantised
    every = np.arange(256) + (int.from_bytes(b" cat", "big") << 8)
    assert abs(np.exp(m.logp(every)).sum() - 1) < 0.02
    got = {r.doc_id: r for r in eftrie.scores(df.union(spark.createDataFrame([(9, None)], df.schema)), m).collect()}
    b = b"\n" * 4 + CORPUS[1].encode()
    want = sum(math.log(p(b[j - 4 : j + 1])) for j in range(4, len(b)))
    assert abs(got[1].log_prob - want) < 0.01 * len(CORPUS[1]) and got[5].perplexity is None and got[9].n_bytes == 0


def test_models_share_shards(spark):
    """Models by number, and that of all text, each equal to one trained alone."""
    rows = [(1, t) for t in CORPUS[:3]] + [(7, t) for t in CORPUS[3:]] + [(None, "zz"), (1, None)]
    m = eftrie.train_models(spark.createDataFrame(rows, "model long, text string"), each=30, pooled=True)
    assert m.models.tolist() == [0, 1, 7]
    for number, corpus in ((0, CORPUS), (1, CORPUS[:3]), (7, CORPUS[3:])):
        p = brute_kn(corpus, ngrams.N)
        g = np.sort([int.from_bytes(x, "big") for x in (b"the c", b"a dog", b"zebra", b"n cat", b"xyzab")])
        assert np.abs(m.logp(g | number << 40) - np.log([p(int(x).to_bytes(5, "big")) for x in g])).max() < 0.03
    assert np.allclose(m.logp(np.array([3 << 40 | 5])), -math.log(256))  # a model that isn't there


def test_packed_runs():
    v = np.array([0, 5, 5, 2**62, 2**62 + 3, 2**63 - 1])
    assert (np.cumsum(eftrie.unpack(eftrie.pack(np.diff(v, prepend=0)), 6)) == v).all() and len(eftrie.unpack(eftrie.pack(v[:0]), 0)) == 0
    g = np.array([0x010203, 0x7F7E7D | 9 << 24])
    assert eftrie.backwards(g, 3, 8).tolist() == [0x030201, 0x7D7E7F | 9 << 24]


def test_pieces_tell_word_order(spark, proto):
    import sentencepiece

    unit = ngrams.Pieces(proto=proto)
    some = ["the cat sat on the mat", "a\nb", None, "", "  ", "日本🎉"]
    ids, offs = unit.symbols(pa.array(some))
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert ids[: offs[1]].tolist() == sp.encode(some[0]) and np.diff(offs).tolist()[2:4] == [0, 0] and offs[5] > offs[4]
    assert sp.decode(ids[offs[1] : offs[2]].tolist()).split() == ["a", "b"] and (ids < unit.size).all()
    odd = [" a  b \n\n c", "a\n", "\nb ", "ab", "ab"]
    ids2, offs2 = unit.symbols(pa.array(odd))
    byte = lambda b: sp.encode(" ")[0] if b == 32 else sp.piece_to_id(f"<0x{b:02X}>")
    a, b, c = (sp.encode(x) for x in "abc")
    want = [[byte(32), *a, byte(32), *b, byte(10), byte(10), byte(32), *c], [*a, byte(10)], [byte(10), *b], sp.encode("ab"), sp.encode("ab")]
    assert [ids2[i:j].tolist() for i, j in zip(offs2, offs2[1:])] == want
    grams = ngrams.codes(ids, offs, unit)
    want = [1, 1, 1, *ids[: offs[1]].tolist()]
    assert [int(g) for g in grams[: offs[1]]] == [sum(x << 15 * (3 - j) for j, x in enumerate(want[i : i + 4])) for i in range(offs[1])]
    rng = random.Random(31)
    stock = ["the", "cat", "sat", "on", "a", "mat", "dog", "and", "end"]
    docs = [(i, " ".join(rng.choice(stock) for _ in range(12))) for i in range(300)] + [(900, "the cat and the dog sat on a mat"), (901, "the cat and the dog sat on a mat"), (902, "zq"), (903, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    m = eftrie.train(df, unit=unit)
    brute = collections.Counter(tuple(x[i : i + 4]) for _, t in docs for x in [[1, 1, 1, *(sp.encode(t) if t else [])]] for i in range(len(x) - 3))
    seen = [(900, "the cat and the dog sat on a mat"), (1, "mat a on sat dog the and cat the"), (2, ""), (3, None)]
    out = {r.doc_id: r for r in eftrie.scores(spark.createDataFrame(seen, df.schema), m).collect()}
    assert out[900].n_bytes == out[1].n_bytes == 32 and out[900].log_prob > out[1].log_prob + 1 and out[2].perplexity is None and out[3].n_bytes == 0
    g = np.array(sorted(sum(x << 15 * (3 - j) for j, x in enumerate(g)) for g in brute))
    assert (m.logp(g) < 0).all()
    context = (int(g[0]) >> 15) << 15  # what follows a context has a probability of 1 in all
    assert abs(np.exp(m.logp(context + np.arange(unit.size))).sum() - 1) < 0.02


@pytest.mark.parametrize("n,u", [(1, 5), (50, 10), (1000, 10**6), (300, 300), (5, 10**12), (64, 0), (3000, 10**5), (500, 2**40)])
def test_elias_fano(n, u):
    v = np.sort(np.random.default_rng(n).integers(0, u + 1, n))
    meta, arrays = eftrie.EliasFano.encode(v)
    e = eftrie.EliasFano(**meta, packed=arrays[0], high=arrays[1], before=arrays[2])
    q = np.random.default_rng(u).integers(0, u + 2, 40)
    z = np.zeros(40, np.int64)
    place, value = e.successor(z, z + n, q)
    assert (e.all() == v).all() and (place == np.searchsorted(v, q)).all() and (value == np.append(v, -1)[place]).all()
    a, b = e.pair(np.arange(n - 1))
    assert (a == v[:-1]).all() and (b == v[1:]).all()
    q = np.minimum(q, v[-1])
    a, b = e.bucket(q)
    assert (a == np.searchsorted(v, q >> e.low << e.low)).all() and (b == np.searchsorted(v, (q >> e.low) + 1 << e.low)).all()


def test_model_edges(spark):
    m = eftrie.train(empty(spark))
    got = eftrie.scores(frame(spark, [(None, "ab"), (1, "ab"), (1, "ab"), (2, "x" * 200_000)]), m).collect()
    assert len(got) == 4 and all(abs(r.perplexity - 256) < 1e-6 for r in got)
    assert eftrie.scores(empty(spark), m).count() == 0


@pytest.mark.parametrize("step", [1, 3, 200, 1 << 13, 1 << 40])
def test_seek_against_search(step):
    rng = np.random.default_rng(step % 97)
    v = np.unique(rng.integers(0, 3000 * step, 9000 if step == 1 else 2000))
    meta, arrays = eftrie.EliasFano.encode(v)
    e = eftrie.EliasFano(**meta, packed=arrays[0], high=arrays[1], before=arrays[2])
    assert (e.all() == v).all()
    lo = np.sort(rng.integers(0, len(v), 4000))
    hi = np.minimum(lo + rng.integers(0, 60, 4000), len(v))
    want = np.where(rng.random(4000) < 0.6, v[np.minimum(lo + rng.integers(0, 60, 4000), len(v) - 1)], rng.integers(0, 3100 * step, 4000))
    at = np.searchsorted(v, want)
    there = (at >= lo) & (at < hi) & (v[np.minimum(at, len(v) - 1)] == want)
    reads = []
    real = e._rest
    e._rest = lambda i: reads.append(len(i)) or real(i)
    assert (e.seek(lo.copy(), hi, want) == np.where(there, at, -1)).all()
    assert (e.low > 0) == (step > 1) == (len(reads) > 0)  # without low bits the high ones tell


def test_ranges_are_read_once_a_context(spark, monkeypatch):
    """However many symbols follow a context, the places of its children are read once a call; what is found is the same."""
    rng = random.Random(12)
    df = spark.createDataFrame([(i, "".join(rng.choice("abcdefgh") for _ in range(4000))) for i in range(3)], "doc_id long, text string")
    m = eftrie.train(df, unit=ngrams.Unit(n=3), each=2000)
    data, offs, _ = kernel.texts(pa.array(["".join(rng.choice("abcdefghi") for _ in range(3000)), "", "ab"]))
    keys = np.unique(ngrams.codes(data, offs, m.unit))
    alone = np.array([m.logp(keys[i : i + 1])[0] for i in range(len(keys))])
    read = []
    real = eftrie.EliasFano.pair
    monkeypatch.setattr(eftrie.EliasFano, "pair", lambda self, i: read.append(len(i)) or real(self, i))
    assert np.abs(m.logp(keys) - alone).max() < 1e-12
    two = np.unique(np.concatenate([keys >> 8, ngrams.cut(keys, 2, 3)]))
    assert len(keys) > 5 * len(two) and sum(read) <= 2 * (len(two) + len(two))


def test_pieces_are_read_in_small_blocks(monkeypatch):
    """A slice of text isn't hashed at once, whatever its size; its pieces are those of its texts."""
    unit = ngrams.Pieces(proto=model_proto())
    rng = random.Random(4)
    rows = [None, "", *(words(rng, rng.randrange(0, 60), 5000) for _ in range(80)), "é\n\n x", "y" * 3000, ""]
    want = [unit.symbols(pa.array([x], pa.string()))[0].tolist() for x in rows]
    most = []
    real = ngrams.spans
    monkeypatch.setattr(ngrams, "spans", lambda data, offs: most.append(len(data)) or real(data, offs))
    monkeypatch.setattr(ngrams, "BLOCK", 500, raising=False)
    monkeypatch.setattr(ngrams, "WORDS", 7, raising=False)
    ngrams._processor.cache_clear()
    got, at = unit.symbols(pa.array(rows, pa.string()))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == want and len(at) == len(rows) + 1
    assert sorted(most)[-2] <= 500 and max(most) == 3000
    assert [len(x) for x in unit.symbols(pa.array([], pa.string()))] == [0, 1]


def test_quality(spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["the", "cat", "sat", "and", "on", "mat", "with"]) for _ in range(60))) for i in range(80)]
    bad = [(100 + i, "".join(chr(rng.randrange(33, 126)) for _ in range(300))) for i in range(10)]
    rows = [*good, *bad, (200, None), (201, ""), (None, "the cat sat"), (0, good[0][1]), (202, "the cat " * 20_000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.scores(frame(spark, rows), labels).collect()
    ok = collections.defaultdict(list)
    for r in got:
        ok[r.doc_id].append(r.accepted)
    assert len(got) == len(rows) and sum(all(ok[i]) for i, _ in good) >= 78 and not any(any(ok[i]) for i, _ in bad) and ok[200] == ok[201] == [False]
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows[:1]).columns and {200, 201, 100}.isdisjoint(r.doc_id for r in kept.collect())
    none = quality.scores(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert all(r.accepted for r in none)
    assert quality.scores(empty(spark), labels).count() == 0


def test_languages_without_trusted_text(spark):
    rng = random.Random(51)
    text = lambda: " ".join(rng.choice(["the", "cat", "sat", "and", "on", "mat", "with"]) for _ in range(60))
    rows = [(i, text(), "aa") for i in range(120)] + [(200 + i, text(), "bb") for i in range(90)] + [(400 + i, text(), "cc") for i in range(60)]
    rows += [(1000 + i, text(), f"x{i:03}") for i in range(230)] + [(2000, text(), "dd"), (2001, text(), None), (3000, "".join(chr(rng.randrange(33, 126)) for _ in range(300)), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(120), *range(400, 460)]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == len(rows) and sum(got[200 + i].accepted for i in range(90)) >= 86 and max(got[200 + i].perplexity for i in range(90)) < 20
    assert sum(got[1000 + i].accepted for i in range(230)) >= 220 and got[2001].perplexity < 20 and not got[3000].accepted


# ---- 5 lines

def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def altered(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, c = rng.randrange(len(s)), rng.random()
        if c < 0.4:
            s[i] = rng.choice("abé")
        elif c < 0.7:
            del s[i]
        else:
            s.insert(i, rng.choice("abé"))
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(tau):
    rng = random.Random(tau)
    pairs = [(a, b) for a in ("".join(rng.choice("abé ") for _ in range(rng.randrange(12, 90))) for _ in range(300)) for b in [altered(rng, a, rng.randrange(tau + 3))] if abs(len(a) - len(b)) <= tau]
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    a, b = (np.array([[ord(c) for c in p[i].ljust(int(n.max()))] for p in pairs], np.int32) for i, n in ((0, la), (1, lb)))
    assert linededup.within(a, la, b, lb, tau).tolist() == [min(tau + 1, edits(*p)) for p in pairs]


def test_near_lines_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(24, 60))) for _ in range(60)]
    lines = base + [altered(rng, x, rng.randrange(1, 5)) for x in base for _ in range(2)]
    rows = [(i, "\n".join(lines[i::20])) for i in range(20)]
    norm = {x for x in (" ".join(x.split()).lower() for x in lines) if len(x) >= 24}
    want = collections.Counter(d for i, x in enumerate(sorted(norm)) for y in sorted(norm)[i + 1 :] if abs(len(x) - len(y)) < 3 and (d := edits(x, y)) < 3)
    got = collections.Counter(r.distance for r in linededup.near_lines(frame(spark, rows)).collect())
    assert got == want and sum(want.values()) > 50


def test_lines_edges(spark):
    x, y = "a line that is long enough to count", "A  line that is  long enough to coun"
    rows = [(2, f"short\n{x}\nshort"), (1, f"{x}\nown text of this one that stays"), (3, y), (3, y), (None, x), (4, None), (5, ""), (6, "short"), (7, "\n".join(f"line {i} {i * 7919} of a long document" for i in range(3000)))]
    df = frame(spark, rows)
    got = sorted((r.doc_id, r.line, r.first_doc_id, r.first_line, r.exact) for r in linededup.repeated_lines(df).where("doc_id < 7").collect())
    assert got == [(2, 1, 1, 0, True), (3, 0, 1, 0, False)] or got == [(2, 1, 1, 0, True), (3, 0, 1, 0, False), (3, 0, 1, 0, False)]
    out = {r.doc_id: (r.text, r.n_chars) for r in linededup.remove_lines(df).collect()}
    assert out[2] == ("short\nshort", 11) and out[1] == (rows[1][1], len(rows[1][1])) and 3 not in out and out[None][0] == x and out[4] == (None, None) and out[5] == ("", 0)
    assert linededup.remove_lines(df).columns == df.columns
    assert linededup.repeated_lines(empty(spark)).count() == 0 and linededup.remove_lines(empty(spark)).count() == 0


def test_memory_of_line_probes(spark):
    """A task holds some 30 MB, and nothing of an earlier stage's words and powers."""
    class Docs:
        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, f, _):
            raise StopIteration(f)

    with pytest.raises(StopIteration) as stop:
        linededup.near_lines(Docs())
    rng = random.Random(8)
    batch = pa.RecordBatch.from_pydict({"id": list(range(400)), "text": ["\n".join(words(rng, 12, 10**6) for _ in range(90)) for _ in range(400)]})
    kernel.powers(kernel.P, 1 << 22), ngrams._processor(model_proto())
    tracemalloc.start()
    rows = sum(b.num_rows for b in stop.value.args[0]([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 400 * 90 and peak < 64 << 20
    assert len(kernel.powers(kernel.P, 9)[0]) < 1 << 22 and not ngrams._processor.cache_info().currsize


def test_short_lines_that_repeat(spark, tmp_path):
    x = "a line that is long enough to count"
    rows = [(1, f"And ornd.\n{x}\n\né"), (2, f"own of 2\n AND  ornd. \n\nx{x}\nÉ"), (3, "And ornd"), (4, "ornd"), (None, "And ornd."), (5, "And ornd.\n and ornd.")]
    rows += [(100 + i, f"unlike {i * 7919}") for i in range(50)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    from tallystone.llm.entries import op5_near_lines

    got = sorted((r.doc_id, r.line, r.first_doc_id, r.first_line, r.exact) for r in op5_near_lines(spark, str(tmp_path)).collect())
    assert got == [(2, 1, 1, 0, True), (2, 3, 1, 1, False), (2, 4, 1, 3, True), (5, 0, 1, 0, True), (5, 1, 1, 0, True)]
    out = {r.doc_id: r.text for r in linededup.remove_lines(frame(spark, rows), least=1).collect()}
    assert out[2] == "own of 2\n" and out[1] == rows[0][1] and 5 not in out and out[3] == "And ornd" and out[None] == "And ornd."


# ---- 6 SimHash

def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    docs = [words(rng, rng.randrange(20, 200), 3000) for _ in range(150)]
    for x in docs[:60]:
        w = x.split()
        for _ in range(2):
            v = [rng.choice(["q", "r", u]) if rng.random() < 0.06 else u for u in w]
            docs.append(" ".join(v))
    w = of(docs)
    _, hi, lo = simhash.fingerprints_of(w)
    n = np.diff(w.off)
    want = {(i, j) for i in range(len(docs)) for j in range(i) if np.bitwise_count(hi[i] ^ hi[j]) + np.bitwise_count(lo[i] ^ lo[j]) <= simhash.RADIUS and abs(math.log(n[i] / n[j])) <= math.log(simhash.RATIO)}
    prints = simhash.fingerprints(frame(spark, list(enumerate(docs))))
    got = {(r.b, r.a) for r in simhash.near_pairs(prints, shard=40, sample=100).collect()}
    assert got == want and len(want) > 60
    for some in (docs[0], "a b c", "a b c d e", "one"):
        w = of([some])
        h = (w.grams(2)[1] if len(w.hash) > 1 else w.hash).tolist()
        got = int(simhash.fingerprints_of(w)[1][0])
        for i in range(64):
            votes = sum(x >> i & 1 for x in h)
            assert got >> i & 1 == (h[0] >> i & 1 if 2 * votes == len(h) else 2 * votes > len(h))


def test_lengths_do_not_matter(spark):
    rng = random.Random(61)
    docs = [words(rng, rng.randrange(30, 90), 5000) for _ in range(120)]
    docs += [f"{x} {x}" for x in docs[:20]] + [" ".join(x.split()[: len(x.split()) * 7 // 10]) for x in docs[20:60]]
    _, hi, lo = simhash.fingerprints_of(of(docs))
    far = np.bitwise_count(hi[:, None] ^ hi).astype(int) + np.bitwise_count(lo[:, None] ^ lo)
    want = {(j, i) for i in range(len(docs)) for j in range(i) if far[i, j] <= simhash.RADIUS}
    got = {(r.a, r.b) for r in simhash.near_pairs(simhash.fingerprints(frame(spark, list(enumerate(docs)))), shard=40, sample=100).collect()}
    assert got == want and {(i, 120 + i) for i in range(20)} <= got and sum(b >= 140 for _, b in got) > 20


def test_near_pairs_do_not_meet_all_pairs():
    rng = np.random.default_rng(3)
    n = 20_000
    hi, lo = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    for i in range(0, 400, 2):  # pairs at all distances up to one over the radius
        bits = np.zeros(128, np.uint8)
        bits[rng.choice(128, 1 + i % 27, replace=False)] = 1
        a, b = np.packbits(bits).view(np.uint64)
        hi[i + 1], lo[i + 1] = hi[i] ^ a, lo[i] ^ b
    parts, own, _ = simhash.plan(hi, lo, n, simhash.RADIUS)
    assert sum(e + 1 for *_, e in parts) == simhash.RADIUS + 1 and sum(b for _, b, _ in parts) == 128
    met, got = 0, set()
    for (first, bits, _), masks in zip(parts, own):
        w = simhash.word(hi, lo, first, bits)
        for m in masks:
            key = (w & m) * simhash.ODD
            size = np.unique(key, return_counts=True)[1]
            met += int((size * (size - 1) // 2).sum())
            got |= {(min(p), max(p)) for p in zip(*(x.tolist() for x in simhash.agreeing(hi, lo, key, simhash.RADIUS)[:2]))}
    assert {(i, i + 1) for i in range(0, 400, 2) if 1 + i % 27 <= simhash.RADIUS} == got
    assert met < n * (n - 1) / 2 / 10


@pytest.mark.parametrize("bits, errors", [(42, 8), (32, 6), (32, 5), (12, 2), (8, 0), (5, 6)])
def test_no_errors_escape_the_masks(bits, errors):
    rng = np.random.default_rng(5)
    masks = simhash.masks(bits, errors)
    for _ in range(300):
        bad = np.bitwise_or.reduce(np.uint64(1) << rng.choice(bits, min(errors, bits), replace=False).astype(np.uint64)) if errors else np.uint64(0)
        assert (masks & bad == 0).any()
    assert simhash.masks(9, -1).size == 0


def test_near_pairs_of_many_alike(spark):
    rng = np.random.default_rng(9)
    flips = np.packbits(np.arange(128) < rng.integers(0, 20, 700)[:, None], axis=1)
    rng.permuted(np.unpackbits(flips, axis=1), axis=1, out=(bits := np.unpackbits(flips, axis=1)))
    both = np.packbits(bits, axis=1).view(np.uint64)
    hi, lo = both[:, 0], both[:, 1]
    rows = [(i, 1 + i % 3, int(a), int(b)) for i, (a, b) in enumerate(zip(hi.view(np.int64), lo.view(np.int64)))]
    far = np.bitwise_count(hi[:, None] ^ hi).astype(int) + np.bitwise_count(lo[:, None] ^ lo)
    want = sorted((i, j, int(far[i, j])) for i in range(700) for j in range(i + 1, 700) if far[i, j] <= simhash.RADIUS)
    prints = spark.createDataFrame(rows, "id long, n long, hi long, lo long").repartition(3)
    for shard in (100, simhash.SHARD):
        assert sorted((r.a, r.b, r.bits) for r in simhash.near_pairs(prints, shard=shard).collect()) == want
    some = {(r.a, r.b) for r in simhash.near_pairs(prints, ratio=1.6).collect()}
    assert some == {(i, j) for i, j, _ in want if max(1 + i % 3, 1 + j % 3) <= 1.6 * min(1 + i % 3, 1 + j % 3)}


def test_short_texts_are_not_near():
    rng = random.Random(13)
    _, hi, lo = simhash.fingerprints_of(of([" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (2, 3, 5, 7) for _ in range(150)]))
    far = np.bitwise_count(hi[:, None] ^ hi) + np.bitwise_count(lo[:, None] ^ lo)
    assert (far[np.triu_indices(len(hi), 1)] > simhash.RADIUS).all()


def test_groups_edges(spark):
    rng = random.Random(8)
    x = words(rng, 80)
    y = x.replace(" ", ", ", 1).upper()
    rows = [(5, x), (3, y), (9, x), (9, x), (1, None), (2, None), (4, ""), (6, ""), (None, x), (None, x), (7, words(rng, 20_000)), (8, "one"), (10, "one")]
    df = frame(spark, rows)
    got = {r.doc_id: (r.group_id, r.group_size) for r in simhash.near_groups(df).collect()}
    assert got == {3: (3, 3), 5: (3, 3), 9: (3, 3), 8: (8, 2), 10: (8, 2)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([3, 1, 2, 4, 6, 7, 8, None, None])
    assert simhash.near_groups(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0
    assert collections.Counter(r.doc_id for r in simhash.keep_one(frame(spark, [(1, x), (1, x), (2, "b c")])).collect()) == {1: 1, 2: 1}


# ---- 7 decontamination

def local(x, y):
    h = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m, n = rng.integers(1, 9, 5), rng.integers(1, 12, 5)
        x, y = rng.integers(0, 4, (5, m.max())), rng.integers(0, 4, (5, n.max()))
        s, a, b = decontam.align(x, m, y, n)
        for i in range(5):
            want = local(x[i, : m[i]], y[i, : n[i]])
            assert s[i] == want and (not want or local(x[i, : m[i]], y[i, a[i] : b[i]]) == want)


def test_leaks(spark):
    rng = random.Random(9)
    items = [words(rng, n, 5000) for n in (12, 40, 60, 5)]
    cut = items[1].split()
    edited = " ".join([*cut[:10], "new", *cut[11:25], *cut[26:]])
    rows = [(1, words(rng, 300, 5000) + " " + items[0] + " " + words(rng, 300, 5000)), (2, edited.upper()), (3, words(rng, 900, 5000)), (4, None), (5, ""), (None, items[0]), (6, items[0]), (6, items[0]), (7, f"{words(rng, 20_000, 5000)} {items[2]}"), (8, " ".join(items[2].split()[:30]))]
    bench = spark.createDataFrame([*[(i, t, "z") for i, t in enumerate(items)], (10, items[0], "z"), (11, None, "z"), (12, "", "z"), (13, "two words", "z"), (None, items[1], "z")], "item_id long, text string, doc_id string")
    for most in (1_000_000, 300):  # whole and in groups
        got = collections.Counter((r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, rows), bench, most=most).collect())
        assert got == {(1, 0): 1, (1, 10): 1, (2, 1): 1, (6, 0): 2, (6, 10): 2, (7, 2): 1, (8, 2): 1}
    r = next(r for r in decontam.leaks(frame(spark, rows), bench).collect() if (r.doc_id, r.item_id) == (1, 0))
    assert (r.start_word, r.end_word, r.similarity) == (300, 312, 1.0)
    assert sorted(r.doc_id or 0 for r in decontam.without_leaks(frame(spark, rows), bench).collect()) == [0, 3, 4, 5]
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_excerpts_of_long_items(spark):
    rng = random.Random(71)
    items = [words(rng, n, 5000) for n in (500, 59)]
    part = lambda i, a, b: " ".join(items[i].split()[a:b])
    rows = [(1, f"{words(rng, 200, 5000)} {part(0, 100, 299)} {words(rng, 200, 5000)}"), (2, f"{words(rng, 50, 5000)} {part(1, 20, 43)} {words(rng, 50, 5000)}"), (3, part(0, 300, 325)), (4, f"{words(rng, 40, 5000)} {part(0, 10, 17)} {words(rng, 40, 5000)}"), (5, words(rng, 900, 5000))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word) for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 0)} and got[2, 1] == (50, 73)
    assert {r.doc_id for r in decontam.without_leaks(frame(spark, rows), bench).collect()} == {4, 5}


# ---- 8 sharding

def test_sharding(spark):
    rng = random.Random(10)
    rows = [(i % 500 if i % 7 else None, "x" * rng.randrange(2000)) for i in range(1500)] + [(3, None), (3, ""), (4, "y" * 50_000)]
    df = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 2 == 0, "b"))
    target = 40_000
    out = sharding.shard(df, ["source", "doc_id"], target=target)
    got = out.select("source", "doc_id", "shard", F.octet_length("text").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert len(got) == len(rows) and out.columns == [c for c in df.columns if c != "shard"] + ["shard"]
    size, where = collections.Counter(), collections.defaultdict(set)
    for r in got:
        size[r.shard] += (r.n or 0) + sharding.BASE
        where[r.shard].add(r.p)
    assert all(len(p) == 1 for p in where.values()) and len(size) > 20
    assert sum(n > 1.6 * target for n in size.values()) <= 2  # the row over the target and a key cut by hash
    by_key = collections.defaultdict(list)
    for r in got:
        by_key[(r.source is not None, r.source or "", r.doc_id is not None, r.doc_id or 0)].append(r.shard)
    low = [(min(v), max(v)) for _, v in sorted(by_key.items())]
    assert all(a[1] <= b[0] for a, b in zip(low, low[1:])) and min(size) == 0 and max(size) <= len(size)
    assert {r.shard for r in sharding.shard(df, ["source"], target=1 << 30, least=1).collect()} == {0}
    assert sharding.shard(empty(spark), ["source"]).count() == 0
    one = sharding.shard(df.withColumn("source", F.lit("same")), ["source"], target=target).groupBy("shard").count().collect()
    assert len(one) > 10 and max(r["count"] for r in one) < 3 * min(r["count"] for r in one)


def test_shards_follow_keys(spark):
    """Few keys of many shards each, and many shards of few draws each, are in key order; shards are near the target."""
    rng = random.Random(12)
    rows = [(i, "x" * 1000, rng.choice(["aa", "bb", "bb", "bb", None, "ff"]), rng.choice([math.nan, 1.5, None, -0.0])) for i in range(3000)]
    df = spark.createDataFrame([*rows, *rows[:200]], "doc_id long, text string, lang string, x double")
    for keys, draws in ((["lang"], 64), (["x", "lang"], 8), (["doc_id"], 2)):
        got = sharding.shard(df, keys, target=20_000, draws=draws).select("doc_id", "lang", "x", "shard").collect()
        place = collections.defaultdict(list)
        for r in got:
            place[sharding.plain([r[k] for k in keys])].append(r.shard)
        order = [(min(place[k]), max(place[k])) for k in sorted(place)]
        assert all(a[1] <= b[0] for a, b in zip(order, order[1:])) and len(got) == 3200
        size = collections.Counter(r.shard for r in got)
        assert set(size) == set(range(len(size))) and 100 < len(size) < 330 and max(size.values()) <= 2.1 * 20_000 / 1016


def test_splitters_against_sorting(spark):
    """With every row drawn, the ranges are those that sorting gives."""
    rng = random.Random(13)
    df = frame(spark, [(rng.randrange(10**6), "x" * rng.randrange(500)) for _ in range(800)])
    got = sharding.shard(df, ["doc_id"], target=10_000, draws=10**9, least=1).select("doc_id", F.octet_length("text").alias("n"), "shard").collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.n + sharding.BASE
    rows = sorted((r.doc_id, r.n + sharding.BASE) for r in got)
    assert [r.shard for r in sorted(got, key=lambda r: r.doc_id)] == sorted(r.shard for r in got)
    assert len(size) - sum(n for _, n in rows) / 10_000 < 4 and max(size.values()) <= 1.25 * 10_000 and min(size.values()) > 5_000


def test_sharding_names(spark):
    df = spark.createDataFrame([(i, "x" * 50, i % 3, i, i, "q") for i in range(300)], "id long, text string, part int, parts long, start long, SHARD string")
    out = sharding.shard(df, ["part", "id"], target=1000)
    assert out.columns == ["id", "text", "part", "parts", "start", "shard"]
    assert sorted((r.id, r.part, r.parts, r.start) for r in out.collect()) == [(i, i % 3, i, i) for i in range(300)]


# ---- 10 passages

def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(11)
    for _ in range(40):
        r = rng.integers(0, 3, int(rng.integers(1, 80)))
        sa, rank = suffix.suffix_array(r)
        want = sorted(range(len(r)), key=lambda i: r[i:].tolist())
        assert sa.tolist() == want
        lcp = suffix.common_prefixes(r, sa, rank, lanes=int(rng.integers(1, 9)))
        for k in range(1, len(r)):
            a, b = r[want[k - 1] :].tolist(), r[want[k] :].tolist()
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("shard", [2000, 1 << 20])
def test_passages(spark, shard):
    rng = random.Random(12)
    shared = [words(rng, n, 9000) for n in (50, 51, 49, 120)]
    rows = []
    for i in range(30):
        mid = rng.choice(shared) if i % 2 else words(rng, 30, 9000)
        rows.append((i, f"{words(rng, rng.randrange(5, 60), 9000)} {mid} {words(rng, 10, 9000)}"))
    long = words(rng, 5000, 90_000)
    rows += [(40, long), (41, long), (42, "to " * 300), (43, None), (44, ""), (None, long), (45, f"{shared[0]} {words(rng, 70)} {shared[0]}"), (46, rows[1][1]), (46, rows[1][1])]
    got = {k: collections.defaultdict(set) for k in (True, False)}
    for r in suffix.shared_passages(frame(spark, rows).repartition(3), shard=shard).collect():
        got[r.first][r.doc_id].update(range(r.start_word, r.end_word))
    docs = {i: t.split() for i, t in rows if i is not None and t}
    occ, want, seen = collections.defaultdict(set), {k: collections.defaultdict(set) for k in (True, False)}, set()
    for i, w in docs.items():
        for p in range(len(w) - 49):
            occ[tuple(w[p : p + 50])].add(i)
    for i in sorted(docs):
        for p in range(len(docs[i]) - 49):
            k = tuple(docs[i][p : p + 50])
            if len(occ[k]) > 1:
                want[k not in seen][i].update(range(p, p + 50))
                seen.add(k)
    assert got == want and 42 not in want[False]
    assert suffix.shared_passages(empty(spark)).count() == 0
