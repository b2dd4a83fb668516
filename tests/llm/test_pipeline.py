"""The pipeline's stages, on a small table with planted cases."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallystone.llm import lattice
from tallystone.llm.entries import model_proto


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(21)
    stock = ["".join(rng.choice("abdegilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    item = words(rng, 30, stock)
    docs = [(i, words(rng, rng.randrange(80, 200), stock), "en") for i in range(200)]
    near = docs[10][1].split()
    near[5] = near[60] = "other"
    docs += [(300, docs[3][1], "en"), (301, " ".join(near), "en"), (302, f"{words(rng, 50, stock)} {item} {words(rng, 50, stock)}", "en"), (303, "#@!$ %^&*( )_+| ~`<> " * 30, "en"), (304, None, "en"), (305, "", None), (306, f"{docs[7][1]}\n{words(rng, 90, stock)}", "en")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(303, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {i: t for i, t, _ in docs}


def test_stages(spark, tables):
    d, text = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(path := f"{d}/stage-{i}")
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert i == 4 or docs.columns == columns
    good = set(range(200))
    assert {303, 304, 305}.isdisjoint(seen[0]) and len(good & seen[0]) >= 198
    assert 300 not in seen[1] and seen[0] - seen[1] == {300}
    assert seen[1] - seen[2] == {301}
    assert seen[2] - seen[3] == {302} and seen[3] == seen[4]
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/stage-3").collect()}
    assert kept[306] == text[306].split("\n")[1] and all(kept[i] == text[i] for i in kept if i < 200)
    samples = collections.Counter(r.doc_id for r in docs.collect())
    assert set(samples.values()) == {corpus_pipeline.SAMPLES}
    back = lattice.decode(docs.where(F.col("sample") == 0), model_proto()).collect()
    assert {r.doc_id: r.text for r in back} == kept


def test_run(spark, tables):
    d, _ = tables
    got = corpus_pipeline.run(spark, d)
    want = spark.read.parquet(f"{d}/stage-4")
    key = lambda df: sorted((r.doc_id, r.sample, tuple(r.ids)) for r in df.collect())
    assert key(got) == key(want)
