"""The corpus pipeline: documents through the stages of STAGES, each written as Parquet and read again.

1. Quality classifier: documents above their language's perplexity threshold go.
2. Line dedup: lines that repeat or nearly repeat an earlier one go, and documents that have none left.
3. SimHash near-dedup: of each group of near copies the smallest id stays.
4. Benchmark decontamination: documents with a passage that aligns with a benchmark item go.
5. SentencePiece encoding: sampled segmentations of what is left.

SQL can't express a language model or a lattice's samples, so ORACLE_SQL is None; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import decontam, lattice, linededup, quality, simhash
from tallystone.llm.entries import model_proto, table, trigrams
from tallystone.llm.shared import stash

SAMPLES = 2


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), unit=trigrams())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.remove_lines(docs, least=1)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.encode(docs, model_proto(), k=SAMPLES)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
