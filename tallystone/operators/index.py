"""The index: versioned tables of chunks and postings, derived from the files and safe to delete.

postings(term, path, seq, dl, at, kind, f) lie in buckets by the term's hash and are sorted by term, so a query's scan opens its
terms' buckets only and skips pages by their statistics; a version is complete before the pointer file names it, and a reader keeps
the version that it began with.
"""

from __future__ import annotations

import os
import time
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallystone.config import Config
from tallystone.functions.text import words_of
from tallystone.operators import chunk
from tallystone.operators.search import KEEP, Query
from tallystone.sources import corpus

#: Folders of postings, and chunks whose words are held at once.
BUCKETS, AT_ONCE = 64, 500


def chunks_of(files: DataFrame) -> DataFrame:
    """files(kind, path, mtime, text) to chunks, by the files' suffix: lines of JSON raw, sessions by turns, other JSON laid out, else notes."""
    name = F.regexp_replace("path", r"\.gz$", "")
    turns = corpus.as_turns(F.col("text"))
    ok = F.expr("try_parse_json(text)").isNotNull()
    files = files.withColumn("__ok", ok).withColumn("turns", F.when(F.col("__ok"), turns))
    is_json = name.endswith(".json")
    session = is_json & (F.col("kind") == "session") & F.col("turns").isNotNull()
    other = is_json & F.col("__ok") & ~session
    files = files.withColumn("__pretty", chunk.pretty_json(F.when(other, F.col("text"))))
    pieces = (
        F.when(name.endswith(".jsonl"), chunk.raw_chunks(F.col("text")))
        .when(session, chunk.session_chunks("turns"))
        .when(is_json & ~F.col("__ok"), chunk.raw_chunks(F.col("text")))
        .when(is_json, chunk.json_chunks(F.col("__pretty")))
        .otherwise(chunk.markdown_chunks(F.when(~name.endswith(".jsonl") & ~is_json, F.col("text"))))
    )
    files = files.withColumn("tail", F.when(session, chunk.session_tail(F.col("turns"))).otherwise(""))
    return chunk.explode_chunks(files, pieces, ["path", "kind", "mtime", "tail"]).select(*KEEP)


def postings(chunks: DataFrame, repeated: bool = False, kinds: bool = False) -> DataFrame:
    """A row for each term of each chunk, with its places, and the chunk's kind if asked for. It takes no shuffle, unless chunks of one path and number may be repeated."""
    more = ["kind"] * kinds
    rows = chunks.select("path", "seq", F.lower("body").alias("low"), *more).mapInArrow(_postings, "path string, seq int, dl int, term string, at array<int>" + ", kind string" * kinds)
    return rows.groupBy("path", "seq", "dl", "term", *more).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at")) if repeated else rows


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(start, AT_ONCE)
            words = [words_of(low or "") for low in batch.column("low").to_pylist()]
            dl = np.fromiter(map(len, words), np.int64, len(words))
            # a stable sort by chunk and term leaves a term's places in order
            coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
            n = max(len(coded.dictionary), 1)
            key = np.repeat(np.arange(len(words)), dl) * n + coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            row = pa.array(key[first] // n)
            places = (np.arange(len(key)) - np.repeat(np.cumsum(dl) - dl, dl))[order]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(places.astype(np.int32)))
            made = {"path": batch.column("path").take(row), "seq": batch.column("seq").take(row), "dl": pa.array(dl.astype(np.int32)).take(row), "term": coded.dictionary.take(pa.array(key[first] % n)), "at": lists}
            yield pa.RecordBatch.from_pydict(made | {k: batch.column(k).take(row) for k in batch.schema.names if k == "kind"})


def build(spark: SparkSession, cfg: Config) -> dict:
    """Rebuilds the whole index and returns files, chunks, seconds, bytes and where it is."""
    began = time.time()
    cfg.index.mkdir(parents=True, exist_ok=True)
    version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:6]}"
    folder = cfg.index / version
    files = corpus.file_texts(corpus.list_files(spark, corpus.default_sources(cfg)))
    write(chunks_of(files), str(folder))
    chunks = spark.read.parquet(f"{folder}/chunks")
    n = chunks.agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks")).first()
    part = cfg.index / f".current-{uuid.uuid4().hex}"
    part.write_text(version)
    os.replace(part, cfg.index / "current")
    size = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    return {"files": n.files, "chunks": n.chunks, "seconds": round(time.time() - began, 2), "bytes": size, "index": str(folder)}


def current(cfg: Config) -> Path:
    try:
        return cfg.index / (cfg.index / "current").read_text()
    except OSError:
        raise FileNotFoundError(f"there is no index in {cfg.index}; build it first") from None


def stats(spark: SparkSession, cfg: Config) -> dict:
    folder = current(cfg)
    chunks = spark.read.parquet(f"{folder}/chunks")
    n = chunks.agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks")).first()
    return {"built_at": folder.stat().st_mtime, "n_files": n.files, "n_chunks": n.chunks, "by_kind": {r["kind"]: r["count"] for r in by_kind(chunks).collect()}}


def by_kind(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").count().orderBy(F.desc("count"), "kind")


def counted(postings_: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(path, seq, dl, f0, ...) of chunks with some phrase, and their kind if postings tell it: the terms' postings, joined per chunk by one aggregation."""
    terms = sorted({t for p in phrases for t in p})
    rows = postings_.where(F.col("term").isin(terms))
    if "bucket" in rows.columns:
        rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})))
    n = F.col("f") if "f" in rows.columns else F.size("at")
    keys = ["path", "seq", "dl", *(k for k in ["kind"] if k in rows.columns)]
    alone, joint = sorted({p[0] for p in phrases if len(p) == 1}), sorted({t for p in phrases if len(p) > 1 for t in p})
    # places are only looked at for phrases of several words
    places = [F.map_from_entries(F.collect_list(F.when(F.col("term").isin(joint), F.struct("term", "at")))).alias("m")] * bool(joint)
    rows = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == t, n)).alias(f"__{i}") for i, t in enumerate(alone)], *places)

    def f(p: list[str]):
        if len(p) == 1:
            return F.coalesce(F.col(f"__{alone.index(p[0])}"), F.lit(0))
        back = lambda k: lambda i: i - k
        here = F.col("m")[p[0]]
        for k, t in enumerate(p[1:], 1):
            here = F.array_intersect(here, F.transform(F.col("m")[t], back(k)))
        return F.coalesce(F.size(here), F.lit(0))

    rows = rows.select(*keys, *[F.when(f(p) > 0, f(p)).otherwise(0).alias(f"f{i}") for i, p in enumerate(phrases)])
    some = F.lit(False)
    for i in range(len(phrases)):
        some = some | (F.col(f"f{i}") > 0)
    return rows.where(some)


def matches(postings_: DataFrame, totals: DataFrame, phrases: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """counted(), and the one row of statistics that BM25 needs; totals has n and avgdl."""
    hits = counted(postings_, phrases)
    some = hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    return hits, totals.crossJoin(some)  # of one row each


def search_frames(chunks: DataFrame, postings_: DataFrame, totals: DataFrame, query: Query, **how) -> DataFrame:
    from tallystone.operators import search as s

    if not query.phrases:
        return s.search(chunks, query, **how)
    found, stats_ = matches(postings_, totals, query.phrases)
    if "kind" not in found.columns:  # an index of before postings told it
        return s.search(chunks.join(found, ["path", "seq"]), query, stats=stats_, **how)
    return s.search(found, query, stats=stats_, bodies=chunks, **how)


def write(chunks: DataFrame, folder: str, repeated: bool = False) -> None:
    """The three tables of an index."""
    spark = chunks.sparkSession
    chunks.write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    rows = postings(chunks, repeated, kinds=True).withColumns({"f": F.size("at"), "bucket": F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int")})
    rows.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "path", "seq").write.partitionBy("bucket").parquet(f"{folder}/postings")
    # a schema, as there are no files without a word
    each = read_postings(spark, folder).agg(F.sum("f").alias("words"))
    chunks.agg(F.count("*").alias("n")).crossJoin(each).select("n", (F.coalesce("words", F.lit(0)) / F.col("n")).alias("avgdl")).write.parquet(f"{folder}/stats")


def read_postings(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Postings of an index; one without any word has no file, and one of an older version no buckets."""
    path = Path(folder) / "postings"
    if not any(path.rglob("*.parquet")):
        return spark.createDataFrame([], "path string, seq int, dl int, term string, at array<int>, kind string, f int, bucket int")
    return spark.read.parquet(str(path))


def tables(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/chunks"), read_postings(spark, folder), spark.read.parquet(f"{folder}/stats")


def search(spark: SparkSession, cfg: Config, query: Query, **how) -> DataFrame:
    """search.search over the index: only the terms' postings and the matching chunks are read."""
    folder = current(cfg)
    return search_frames(*tables(spark, folder), query, **how)
