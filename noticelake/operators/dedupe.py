"""Keeping the first row per key, and joins with dimension tables of a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.session import deals, scratch_path


#: Tasks that share the html of one task of a scan, which reads up to 128 MB of compressed columns.
PER_SCAN = 4


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` straight above the window lets Spark keep one row per key and task
    before the shuffle, so a key that holds a third of all rows sends one row per task.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def dedupe_first(
    notices: DataFrame,
    key: str = "notice_key",
    order: Sequence[Column | str] = ("board_ord", "row_pos"),
) -> DataFrame:
    """First notice per identity. The order must be total, arrival order is none."""
    return first_per_key(notices, [key], order)


def dedupe_stored(
    notices: DataFrame, key: str = "notice_key", order: Sequence[Column | str] = ("board_ord", "row_pos"),
    max_rows: int = 200_000,
) -> DataFrame:
    """``dedupe_first`` of stored notices, which are read once more: keys that come more than once are found on
    their hashes, and only rows with one of these meet a shuffle. Beyond ``max_rows`` such hashes all do."""
    at = F.xxhash64(key).alias("_at")
    path = scratch_path(notices.sparkSession, "repeated")
    notices.select(at).groupBy("_at").agg(F.count("*").alias("n")).filter("n > 1").select("_at").write.parquet(
        path, compression="zstd")
    repeated = notices.sparkSession.read.parquet(path)
    found = repeated.limit(max_rows + 1).count()
    if found == 0:
        return notices
    if found > max_rows:
        return dedupe_first(notices, key, order)
    placed = notices.select("*", at)
    again = dedupe_first(placed.join(F.broadcast(repeated), "_at", "left_semi"), key, order)
    return placed.join(F.broadcast(repeated), "_at", "left_anti").unionByName(again).drop("_at")


def id_collisions(notices: DataFrame) -> DataFrame:
    """Displayed ids shared by notices with different keys (after ``dedupe_first``)."""
    return notices.groupBy("id").agg(F.count("*").alias("notices")).filter("notices > 1")


def join_dimension(
    fact: DataFrame, dimension: DataFrame, on, how: str = "left", max_rows: int = 200_000
) -> DataFrame:
    """Join with a stored dimension: broadcast if it has at most ``max_rows`` rows.

    A larger one is joined by shuffle, with skewed keys split at run time.
    """
    return fact.join(F.broadcast(dimension) if _small(dimension, max_rows) else dimension, on, how)


def _small(dimension: DataFrame, max_rows: int) -> bool:
    return dimension.limit(max_rows + 1).count() <= max_rows


def latest_fetch(pages: DataFrame) -> Column:
    """What orders the fetches of a URL: when they were made, where that is known, then the page id."""
    return F.struct(*[c for c in ("fetched_at", "page_id") if c in pages.columns])


def latest_pages(pages: DataFrame, urls: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``(url, page_id)`` of the last fetch of each of the stored ``urls``, which may repeat; html is not read.

    Up to ``max_rows`` urls travel to the pages. Of more, every url of the pages is grouped, once, and those
    nobody asked for come along: whoever asks joins with the result anyhow.
    """
    if _small(urls, max_rows):
        pages = pages.join(F.broadcast(urls.distinct()), "url", "left_semi")
    if "fetched_at" not in pages.columns:
        # Grouped by hash; a struct would have to be sorted.
        return pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    last = pages.select("url", latest_fetch(pages).alias("_fetch")).groupBy("url").agg(F.max("_fetch").alias("_fetch"))
    return last.select("url", "_fetch.page_id")


def found_pages(owners: DataFrame, pages: DataFrame, url: str) -> DataFrame:
    """Stored rows with the ``page_id`` of the last fetch of their column ``url`` and ``page_found``, written once.

    html is not read, and URLs of pages are read once for the rows that have a page and those that have none.
    """
    spark = owners.sparkSession
    last = latest_pages(pages, owners.select(F.col(url).alias("url")))
    last = last.withColumnRenamed("url", url).withColumn("page_found", F.lit(True))
    path = scratch_path(spark, "fetches")
    owners.join(last, url, "left").withColumn("page_found", F.col("page_found").isNotNull()).write.parquet(
        path, compression="zstd")
    return spark.read.parquet(path)


def with_html(owners: DataFrame, pages: DataFrame, url: str, max_rows: int = 200_000) -> DataFrame:
    """Stored rows with the html of the page in their column ``url``; rows without one go.

    Of several fetches of a URL the last one counts. It is found on ids alone; then the owners
    travel to its row by page id while their number is within the bound, so html without an owner
    is not shuffled. The rows found are dealt out: pages of one kind are often stored side by side,
    and a parse where they lie would leave them to a few tasks.
    """
    found = found_pages(owners, pages, url).filter("page_found").drop("page_found")
    return html_of_found(found, pages, max_rows)


def html_of_found(found: DataFrame, pages: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Rows of ``found_pages`` that have a page, with its html in place of the ``page_id``."""
    spark, html = found.sparkSession, pages.select("page_id", "html")
    if _small(found, max_rows):
        joined = html.join(F.broadcast(found), "page_id")
        joined = joined.repartition(deals(spark), *(c for c in joined.columns if c != "html"))
    else:
        # The join's own shuffle deals them; with a number it is not merged into few tasks. The number follows
        # the bytes that are stored, so that a task's share of the html stays of one size.
        tasks = max(deals(spark), PER_SCAN * pages.rdd.getNumPartitions())
        joined = html.repartition(tasks, "page_id").join(found.repartition(tasks, "page_id").hint("merge"), "page_id")
    return joined.drop("page_id")


def without_page(owners: DataFrame, pages: DataFrame, url: str) -> DataFrame:
    """Stored rows whose page is not there. Only page URLs are read."""
    seen = join_dimension(
        pages.select(F.col("url").alias(url)), owners.select(url).distinct(), url, "left_semi"
    )
    return owners.join(seen.distinct(), url, "left_anti")
