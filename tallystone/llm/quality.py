"""Quality classifier: perplexity under interpolated modified Kneser-Ney n-grams of trusted text.

Trusted are the labelled documents of quality 1 that aren't toxic. All of them are used: four in five (by a hash of the id) for
the counts, the fifth for the thresholds. Grams are of 3 SentencePiece pieces in the queries, or of 5 bytes (`unit`). Each language
of counted text has its own model; one of all that text serves documents whose language is null or has none. Counts are added up,
and joined with what they are divided by, in shards by n-gram (see eftrie); a task then joins its documents' distinct n-grams with
each shard in turn, so no document is shuffled.

A document's `bound` is its mean negative log probability a symbol, less `z` standard errors, so that a short text isn't rejected
by chance. A language's threshold is the `quantile` of the bound over its held-out trusted documents, and is at least `slack`
above their median; both are read off the counts of bounds in steps of STEP, which Spark adds up. Documents above it are rejected.

Edge cases: null and empty texts have no perplexity and are rejected. Without trusted text nothing can be told and all other
documents are accepted; a language without held-out text has the threshold of all of it. A document of several rows is kept if one
of them is accepted. In keep_good, rows with a null id stay. Repeated and conflicting labels: a document is trusted if all its labels
agree. A very long text is read whole. Equal bounds share a fate. An empty table gives none. Other columns may have any names;
keep_good returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import eftrie
from .kernel import release, slices, texts
from .ngrams import BYTES, Unit
from .shared import fresh, in_lists, sorted_lists, stash

QUANTILE, Z, SLACK, STEP = 0.995, 2.0, 0.05, 0.001


def quantiles(rows: DataFrame, by: str, value: str, q: dict[str, float], step: float = STEP) -> DataFrame:
    """(by, each name in q): the least multiple of step that is at or above so large a share of the values of its group."""
    bins = rows.groupBy(by, F.ceil(F.col(value) / step).alias("bin")).agg(F.count("*").alias("n"))
    window = Window.partitionBy(by)
    run = F.sum("n").over(window.orderBy("bin")) / F.sum("n").over(window)
    return bins.select(by, "bin", run.alias("share")).groupBy(by).agg(*(F.min(F.when(F.col("share") >= x, F.col("bin") * step)).alias(name) for name, x in q.items()))


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, z: float = Z, slack: float = SLACK, unit: Unit = BYTES) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, accepted) of every row; perplexity is a symbol's, threshold in perplexity, of the bound."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    trusted = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("id")
    held = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0
    counted = stash(trusted.where(~held), "trusted")
    sizes = docs.select("id", "lang", F.octet_length("text").alias("n")).where("n > 0").join(counted, "id", "left_semi").groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row a language
    common = sorted(r.lang for r in sizes if r.lang is not None)
    if len(common) >= unit.models:
        raise ValueError(f"{len(common)} languages, and numbers for {unit.models - 1}")
    # a row a language, fewer than unit.models: sent along, else the text would be shuffled by language
    numbers = spark.createDataFrame([(c, i) for i, c in enumerate(common, 1)], "lang string, model long")
    docs = docs.join(F.broadcast(numbers), "lang", "left").select("id", "text", "lang", F.coalesce("model", F.lit(0)).alias("model"))
    lists = sorted_lists(counted, "trusted-ids")

    def only(batch):
        ids = batch.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        use = np.zeros(len(ids), bool)
        use[order] = in_lists(lists, ids[order])
        return batch.filter(pa.array(use))

    model = eftrie.train_models(docs.select("id", "model", "text").where("id is not null"), unit, keep=only, pooled=True, total=sum(r.n for r in sizes))

    def score(batches):
        release()
        run = eftrie.Scorer(model)
        for batch in batches:
            for part in slices(batch, "text", eftrie.SLICE // 4):
                size = np.diff(texts(part.column("text"))[1])
                data, offs = unit.symbols(part.column("text"))
                total, square = run(data, offs, part.column("model").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), part.column("model"), pa.array(size), pa.array(np.diff(offs)), pa.array(-total), pa.array(square)], ["id", "lang", "model", "size", "n", "nll", "square"])

    rows = docs.select("id", "lang", "model", "text").mapInArrow(score, "id long, lang string, model long, size long, n long, nll double, square double")
    rows = rows.withColumn("mean", F.expr("try_divide(nll, n)"))
    rows = stash(rows.withColumn("bound", F.expr(f"mean - {float(z)}D * sqrt(try_divide(greatest(try_divide(square, n) - mean * mean, 0D), n))")), "scores")
    kept = rows.join(trusted.where(held), "id", "left_semi").where("bound is not null")
    kept = kept.select("model", "bound").union(kept.select(F.lit(-1).cast("long"), "bound"))
    limits = {r.model: max(r.top, r.mid + slack) for r in quantiles(kept, "model", "bound", {"top": quantile, "mid": 0.5}).collect()}  # a row a language
    general = limits.get(-1)
    table = spark.createDataFrame([(m, limits.get(m, general)) for m in range(len(common) + 1)], "model long, t double")
    rows = rows.join(F.broadcast(table), "model", "left")
    fine = (F.col("n") > 0) & (F.lit(True) if not sizes or general is None else F.col("bound") <= F.col("t"))
    return rows.select(F.col("id").alias(id), F.col("lang").alias(lang), F.col("size").alias("n_bytes"), F.exp("mean").alias("perplexity"), F.exp("t").alias("threshold"), F.coalesce(fine, F.lit(False)).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", unit: Unit = BYTES) -> DataFrame:
    """docs without the rejected."""
    bad = fresh(docs, "bad")
    gone = scores(docs, labels, id, text, lang, unit=unit).groupBy(F.col(id).alias(bad)).agg(F.max("accepted").alias("ok")).where("not ok").select(bad)
    return docs.join(gone, docs[id] == gone[bad], "left_anti")
