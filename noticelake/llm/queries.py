"""One query per operator over its whole table, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import (
    decontaminate,
    divergence,
    hosts,
    language,
    manifest,
    negatives,
    packing,
    quality,
    recompression,
    simhash,
    suffixes,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op3_suffix_dedup(spark, d):
    return suffixes.repeated_spans(_table(spark, d, "documents"))


@query
def op8_substring_dedup(spark, d):
    return recompression.dedup_substrings(_table(spark, d, "documents"))


@query
def op4_simhash_near_dedup(spark, d):
    return simhash.near_duplicates(_table(spark, d, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op5_packing(spark, d):
    return packing.pack(_table(spark, d, "documents"))


@query
def op1_quality_classifier(spark, d):
    documents = _table(spark, d, "documents")
    model = quality.train(documents, _table(spark, d, "labels"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", quality.held_out().alias("held_out"))
    return quality.scored(rows, model).select(
        "doc_id", "held_out", "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op2_benchmark_decontamination(spark, d):
    return decontaminate.overlaps(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


@query
def op9_language_id(spark, d):
    documents = _table(spark, d, "documents")
    return language.identify(documents, language.train(documents))


@query
def op6_divergence_rules(spark, d):
    return divergence.judged(_table(spark, d, "documents"))


@query
def op7_url_filter(spark, d):
    return hosts.judged(_table(spark, d, "pages"))


@query
def op10_warc_revisits(spark, d):
    found = warc.resolve_revisits(warc.captures(_table(spark, d, "pages")))
    return found.withColumn("headers", warc.header_lines(F.col("headers")))


@query
def op11_merkle_manifest(spark, d):
    return manifest.proved(_table(spark, d, "documents"), altered=manifest.tampered()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_toxicity(spark, d):
    documents = _table(spark, d, "documents")
    return toxicity.toxic(documents, toxicity.train(documents, _table(spark, d, "labels")))


@query
def op13_hard_negatives(spark, d):
    rows = _table(spark, d, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(rows, F.col("id") % 100 == 0)


ORACLES["op10_warc_revisits"] = warc.SQL
ORACLES["op11_merkle_manifest"] = manifest.SQL
ORACLES["op13_hard_negatives"] = negatives.SQL
