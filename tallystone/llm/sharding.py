"""Sharding by sampled splitters.

1. Rows are drawn with a probability in proportion to their size (Poisson sampling, each row by itself) and weigh size / probability.
   Some `draws` * sqrt(shards) drawn keys are all that the driver holds: their weighted quantiles cut the table into sqrt(shards) ranges.
2. Some `draws` rows a shard are drawn for the ranges' own splitters. Their weights are added up by range and key, so that a key of any
   share is one row, and each range's quantiles are taken where it is grouped. They are files in the shared folder; a task reads those of the
   ranges that its rows fall in and finds a row's shard by binary search.
3. Shards of more than `over` * target bytes that have several keys are cut again, by the sizes of all their keys rather than by draws. What is
   still overfull is a single key, and is cut by a hash of the row and its place in the scan, so that copies of a row are spread too.

Shards are numbered in key order, from 0; those of a key that had to be cut by hash are neighbours. They have about `target` bytes (or fewer: there
are `least` shards' worth at least), unless one row is larger; of a key that few rows have, one may be empty. The result has all columns and `shard`, and each shard's rows are one partition.

Edge cases: null key parts come first, NaN last. A null text has size 0, and each row counts `base` bytes besides; a very long text is a row like
others. Ties share a shard unless they overfill it. A column of the input named like the output, in any case of letters, is replaced, and can't be a
key; others may have any names. Repeated rows stay. An empty table gives none.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import fresh, map_blob, new_path, stash, write_blob

TARGET, DRAWS, OVER, BASE, LEAST = 64 << 20, 64, 1.25, 16, 32
BITS = 20  # of a range's number in a shard's, and of a shard's in one that was cut again


def splitters(keys: list[tuple], weight: np.ndarray, shards: int) -> list[tuple]:
    """Keys that cut the weight into `shards` even parts; a key repeated often enough is but one splitter."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    run = np.cumsum(weight[order])
    cuts = np.searchsorted(run, run[-1] * np.arange(1, shards) / shards) if len(run) else []
    return sorted({keys[order[i]] for i in cuts})


def refine(keys: list[tuple], weight: list[float], target: int) -> list[tuple]:
    """Keys before which a shard is full; a key larger than the target is cut off on both sides."""
    by: dict[tuple, float] = {}
    for k, w in zip(keys, weight):
        by[k] = by.get(k, 0.0) + w
    cuts, full = [], 0.0
    for k in sorted(by):
        if full and full + by[k] > target:
            cuts.append(k)
            full = 0.0
        full += by[k]
    return cuts


def plain(values) -> tuple:
    """A key as a tuple that Python orders: nulls, then values, then NaN."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


def plains(column) -> list[tuple]:
    """Keys of an Arrow column of structs."""
    return [plain(k.values()) for k in column.to_pylist()]


@lru_cache(4096)
def _cuts(path: str) -> list[tuple]:
    return pickle.loads(map_blob(path).tobytes())


def shard(docs: DataFrame, keys: list[str], text: str = "text", target: int = TARGET, column: str = "shard", draws: int = DRAWS, over: float = OVER, base: int = BASE, least: int = LEAST) -> DataFrame:
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() != column.lower()]
    docs = docs.select(*columns)
    light = docs.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + base).alias("size"))
    total = light.agg(F.sum("size")).first()[0] or 0
    target = max(1, min(target, -(-total // least)))
    shards = -(-total // target)
    path = new_path(spark, "splitters")

    def drawn(rows: DataFrame, per: float, seed: int) -> DataFrame:
        """Rows drawn, so many a byte, with their weights."""
        p = F.least(F.col("size") * per, F.lit(1.0))
        return rows.withColumn("p", p).where(F.rand(seed) < F.col("p")).withColumn("w", F.col("size") / F.col("p"))

    ranges = math.isqrt(max(shards - 1, 0)) + 1
    some = drawn(light, draws * ranges / max(total, 1), 1).select("key", "w").toArrow()  # draws * sqrt(shards) rows or so
    coarse = splitters(plains(some.column("key")), some.column("w").to_numpy(), ranges)

    def number(levels: list[set[int] | None]):
        """A row's range; for each level (None: all) the ids that it cuts, by the files that bear their numbers."""

        @F.arrow_udf("long")
        def of(column: pa.Array) -> pa.Array:
            out = []
            for k in plains(column):
                n = bisect_right(coarse, k)
                for level, cut in enumerate(levels):
                    n = n << BITS | (bisect_right(_cuts(f"{path}/{level}-{n}"), k) if cut is None or n in cut else 0)
                out.append(n)
            return pa.array(out, pa.int64())

        return of

    def cut(rows: DataFrame, level: int) -> None:
        """Files of splitters from rows (id, key, w), a row a key."""

        def write(t: pa.Table) -> pa.Table:
            n = t.column("id")[0].as_py()
            keys_, weight = plains(t.column("key")), t.column("w").to_numpy().astype(float)
            found = refine(keys_, weight, target) if level else splitters(keys_, weight, max(1, round(weight.sum() / target)))
            write_blob(f"{path}/{level}-{n}", pickle.dumps(found))
            return t.select(["id"]).slice(0, 1)

        rows.groupBy("id", "key").agg(F.sum("w").alias("w")).groupBy("id").applyInArrow(write, "id long").write.format("noop").mode("overwrite").save()

    if shards:
        for i in range(len(coarse) + 1):
            write_blob(f"{path}/0-{i}", pickle.dumps([]))  # of ranges of which nothing is drawn
        cut(drawn(light, draws / target, 2).select(number([])("key").alias("id"), "key", "w"), 0)
    sizes = light.select(number([None])("key").alias("id"), "key", "size").groupBy("id").agg(F.sum("size").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    full = {r.id for r in sizes.where((F.col("n") > over * target) & (F.col("lo") < F.col("hi"))).select("id").collect()}  # the few that the draws left too large
    if full:
        cut(light.select(number([None])("key").alias("id"), "key", F.col("size").alias("w")).where(F.col("id").isin(list(full))), 1)
    of = number([None, full])
    sizes = light.select(of("key").alias("id"), "size").groupBy("id").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    parts = F.when(F.col("n") > over * target, F.least(F.ceil(F.col("n") / target), "rows")).otherwise(1)
    sizes = sizes.select("id", F.shiftright("id", 2 * BITS).alias("range"), parts.alias("parts"))
    first = F.sum("parts").over(Window.partitionBy("range").orderBy("id")) - F.col("parts")
    sizes = stash(sizes.withColumn("first", first), "shards")
    begin, at = [], 0
    for r in sizes.groupBy("range").agg(F.sum("parts").alias("n")).orderBy("range").collect():  # sqrt(shards) rows
        begin.append((r["range"], at))
        at += r.n
    numbers = sizes.join(spark.createDataFrame(begin, "range long, begin long"), "range")
    id, part, parts, start = fresh(docs, "id", "part", "parts", "start")
    numbers = numbers.select(F.col("id").alias(id), F.col("parts").alias(parts), (F.col("first") + F.col("begin")).cast("int").alias(start))
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in columns if kinds[c] not in ("map", "variant")], F.monotonically_increasing_id())
    rows = docs.withColumn(part, salt).withColumn(id, of(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])))
    out = joined(rows, numbers, id, at).withColumn(column, (F.col(start) + F.pmod(F.col(part), F.col(parts))).cast("int")).select(*[F.col(f"`{c}`") for c in columns], column)
    return out.repartitionById(max(at, 1), column)


#: Rows of two longs and an int that are sent to each executor at most.
SMALL = 1 << 20


def joined(rows: DataFrame, numbers: DataFrame, id: str, count: int) -> DataFrame:
    """rows with the shards' numbers: sent along up to SMALL shards; beyond, by a join on the id, in which a key's rows are split by AQE."""
    return rows.join(F.broadcast(numbers) if count <= SMALL else numbers, id)
