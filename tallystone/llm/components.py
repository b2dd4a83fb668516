"""Connected components of an edge list, by joins that shrink it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stash


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root), root the smallest node of the component.

    Alternates large-star and small-star (Kiveris et al., 2014) until nothing changes; each round's
    edges are written to the shared folder. Rounds grow with the logarithm of the diameter.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stash(small.where("u <> v").distinct(), "edges")
        mark = lambda d: d.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark(after) == mark(e):
            break
        e = after
    roots = after.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
