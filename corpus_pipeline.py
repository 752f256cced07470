"""The documents table made into training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept:

1. quality: documents that the classifier scores below its threshold go.
2. near_dedup: of each group linked by SimHash fingerprints within 4 bits (operator 4), or by a similarity
   of 0.8 or more over 5 words, the smallest doc_id stays.
3. suffix_dedup: passages of 50 or more words that stand earlier in the corpus are cut out.
4. decontaminate: documents that overlap a benchmark item go.
5. pack: what is left is cut into sequences of at most 2,048 tokens.

All but the last return the columns of documents; n_chars follows the text. Null texts, empty
texts and empty tables pass through as the operators say; extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import decontaminate as leaks
from noticelake.llm import packing, quality, simhash, suffixes
from noticelake.llm.repeats import stored

#: The tokenizer, the boosted model and the chain of passes are not SQL; tests/llm compares each
#: stage with a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
