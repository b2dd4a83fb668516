"""The queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audio, decontam, eftrie, lattice, licences, linededup, ngrams, quality, sharding, simhash, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"


def model_proto(folder: str = TOKENIZERS, name: str = "piece_bpe_32k.model") -> bytes:
    return Path(folder, name).read_bytes()


def trigrams() -> ngrams.Unit:
    """The quality classifier's grams: of 3 pieces, which leaves room for the languages' numbers."""
    return ngrams.Pieces(n=3, proto=model_proto())


def op1_telephony_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio, so each document's bytes are taken as a recording of 8,000 samples a second, in the three codecs by turns."""
    codec = F.element_at(F.array(*map(F.lit, ("mulaw", "alaw", "adpcm"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    media = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"), codec.alias("codec"), F.lit(8000).alias("rate"))
    return audio.decode_audio(media, "doc_id")


def op2_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(table(spark, sf_dir, "documents"), model_proto(), k=2)


def op3_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.licences(docs, licences.train(docs))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), unit=trigrams())


def op5_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents"), least=1)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), ["source", "doc_id"])


def op9_corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return eftrie.scores(docs, eftrie.train(docs, unit=ngrams.Pieces(proto=model_proto())))


def op10_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.shared_passages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_telephony_pcm, op2_sampled_segmentations, op3_licence_paragraphs, op4_quality_scores, op5_near_lines, op6_simhash_groups, op7_benchmark_leaks, op8_range_shards, op9_corpus_scores, op10_suffix_passages)}
SQL: dict[str, str] = {}
