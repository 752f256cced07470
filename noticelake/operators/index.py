"""Inverted index: postings, header, export blocks, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.config import IndexRules
from noticelake.functions.text import index_tokens, tokenize


def build_postings(
    notices: DataFrame, rules: IndexRules = IndexRules(), columns: Sequence[str] = ("notice_key", "id")
) -> DataFrame:
    """``(token, notice_key, id)``, each token of a notice once; ``columns`` names others to point by.

    Displayed ids can collide, so ``notice_key`` is what a posting points to; it must be unique
    among the notices. Repeats inside a notice go before the rows are made: no shuffle.
    """
    tokens = index_tokens(
        F.col("title"),
        F.col("campus"),
        F.col("department_name"),
        F.col("board_name"),
        F.col("college"),
        rules,
    )
    return notices.select(
        F.explode(F.array_distinct(tokens)).alias("token"), *columns
    )


def index_header(postings: DataFrame, notices: DataFrame, rules: IndexRules = IndexRules()) -> DataFrame:
    """One row: ``version, notice_count, token_count``."""
    both = postings.groupBy("token").agg(F.lit(0).alias("n")).select(
        F.lit(1).alias("tokens"), F.lit(0).alias("notices")
    ).unionByName(notices.select(F.lit(0).alias("tokens"), F.lit(1).alias("notices")))
    return both.agg(
        F.lit(rules.version).alias("version"),
        F.coalesce(F.sum("notices"), F.lit(0)).alias("notice_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("token_count"),
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("doc_freq"))


def sorted_postings(
    postings: DataFrame, order: Sequence[str] = ("token", "id", "notice_key")
) -> DataFrame:
    """Postings in (token, id, notice_key) order, range-partitioned on all three: a token that
    hits every notice is cut into as many ranges as it needs."""
    return postings.repartitionByRange(*order).sortWithinPartitions(*order)


def export_index(postings: DataFrame, max_ids: int = 100_000) -> DataFrame:
    """Array form: ``token, block, blocks, doc_freq, ids`` with ids ascending in a block.

    A token with up to ``max_ids`` ids is one block, as a reader of the plain map expects.
    Above that its ids are spread over as many blocks as it takes; all of them together are
    the complete list.
    """
    sized = postings.join(document_frequency(postings), "token").withColumn(
        "blocks", F.ceil(F.col("doc_freq") / F.lit(max_ids)).cast("long")
    )
    return (
        sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .groupBy("token", "block", "blocks", "doc_freq")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


def live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows ``(notice_key, layer, ...)`` whose key no later layer declares dead.

    ``dead`` is ``(notice_key, layer)``; a layer's dead keys concern the layers before it.
    """
    last = dead.groupBy("notice_key").agg(F.max("layer").alias("_dead"))
    joined = rows.join(last, "notice_key", "left")
    return joined.filter(F.col("_dead").isNull() | (F.col("layer") >= F.col("_dead"))).drop("_dead")


def token_changes(added: DataFrame, dropped: DataFrame) -> DataFrame:
    """``(token, notices)``: by how much the notices of each token grew or shrank."""
    signed = added.select("token", F.lit(1).alias("n")).unionByName(
        dropped.select("token", F.lit(-1).alias("n"))
    )
    return sum_changes(signed.select("token", F.col("n").cast("long").alias("notices")))


def sum_changes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("token").agg(F.sum("notices").alias("notices")).filter("notices <> 0")


def first_to_merge(sizes: list[int], fan: int = 2) -> int:
    """The oldest of the newest layers to merge into one; the newest itself means none.

    Layers are taken in while the one before holds less than ``fan`` times what is taken so far.
    What stays has sizes that fall at least by ``fan`` each, so there are few layers, and a row is
    rewritten only when the rows above it have grown with it.
    """
    start, taken = len(sizes) - 1, sizes[-1]
    while start and sizes[start - 1] < fan * taken:
        start -= 1
        taken += sizes[start]
    return start


def query_tokens(df: DataFrame, query: str, rules: IndexRules = IndexRules()) -> list[str]:
    """Distinct tokens of a query text, cut by the same rules as the index."""
    one = df.sparkSession.range(1)
    words = F.array_distinct(tokenize(F.lit(query), rules.min_token_bytes))
    return one.select(words.alias("words")).first()["words"]


def search_ids(postings: DataFrame, query: str, rules: IndexRules = IndexRules()) -> DataFrame:
    """Keys and ids of notices that have every query token. The token filter reaches the scan."""
    tokens = query_tokens(postings, query, rules)
    hits = postings.filter(F.col("token").isin(tokens))
    return (
        hits.groupBy("notice_key")
        .agg(F.count("*").alias("matched"), F.first("id").alias("id"))
        .filter(F.col("matched") == len(tokens))
        .select("notice_key", "id")
    )


def search_notices(
    postings: DataFrame, notices: DataFrame, query: str, rules: IndexRules = IndexRules()
) -> DataFrame:
    """Notices found through the index; a query without usable tokens finds none."""
    return notices.join(search_ids(postings, query, rules), "notice_key", "left_semi")
