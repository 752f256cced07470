"""Board listings to notice rows, and the counts that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.config import Cleaning
from noticelake.functions.dates import normalize_date
from noticelake.functions.ids import canonical_id, extract_notice_id, notice_digest, notice_key
from noticelake.functions.selectors import selector_supported
from noticelake.functions.text import clean_date, clean_title, has_title, strip_ws
from noticelake.functions.urls import resolve_url
from noticelake.sources.row_matcher import match_rows

BOARD_KEY = ("campus", "college", "department_id", "board_url")
_REQUIRED = ("row_selector", "title_selector", "date_selector")
_OPTIONAL = ("author_selector", "link_selector")


def check_selectors(boards: DataFrame) -> DataFrame:
    """Add ``invalid_selector``: the first required selector of an unknown form, else NULL."""
    first_bad = F.coalesce(
        *[
            F.when(~F.coalesce(selector_supported(F.col(c)), F.lit(False)),
                   F.coalesce(F.col(c), F.lit("")))
            for c in _REQUIRED
        ]
    )
    return boards.withColumn("invalid_selector", first_bad)


def selector_errors(boards: DataFrame) -> DataFrame:
    """One error per unusable selector. After a required one the rest is not looked at."""
    checked = check_selectors(boards)
    optional = [
        F.when(F.col("invalid_selector").isNull() & ~selector_supported(F.col(c)), F.col(c))
        for c in _OPTIONAL
    ]
    return checked.select(
        F.lit("selector").alias("stage"),
        "board_id",
        "board_name",
        F.col("board_url").alias("url"),
        F.lit(None).cast("string").alias("notice_id"),
        F.explode(F.array_compact(F.array("invalid_selector", *optional))).alias("_bad"),
        F.lit(False).alias("retryable"),
    ).select(
        "stage", "board_id", "board_name", "url", "notice_id",
        F.concat(F.lit("unsupported selector: "), F.col("_bad")).alias("message"), "retryable",
    )


def extract_notice_rows(
    board_pages: DataFrame, cleaning: Cleaning, html: str = "html"
) -> DataFrame:
    """Rows of each board's listing page, good and bad.

    Input: boards with the html of their page. A row is good (``ok``) when it has a title and
    a date element and its cleaned title is not empty. A board without any row keeps one
    record with a NULL ``row_pos``, so the counts see it.
    """
    rows = match_rows(board_pages, html).withColumns(
        {
            "title": clean_title(F.col("raw_title"), cleaning),
            "date": clean_date(F.col("raw_date"), cleaning),
            "author": F.coalesce(strip_ws(F.col("raw_author")), F.lit("")),
        }
    ).withColumn(
        "ok",
        F.col("row_pos").isNotNull() & F.col("raw_date").isNotNull() & has_title(F.col("title")),
    )
    # Without its attribute a link is the board itself: such rows are counted, as ids of one day may collapse.
    missing = F.col("row_pos").isNotNull() & (F.coalesce(F.col("raw_link"), F.lit("")) == "")
    rows = rows.withColumn("link_missing", missing)
    return rows.withColumn("link", resolve_url(F.col("board_url"), F.col("raw_link"))).drop(
        "raw_title", "raw_date", "raw_author"
    )


def row_accounting(rows: DataFrame, key=BOARD_KEY) -> DataFrame:
    """Per board: ``row_total``, ``row_failures``."""
    return rows.groupBy(*key).agg(
        F.count("row_pos").alias("row_total"),
        F.count_if(F.col("row_pos").isNotNull() & ~F.col("ok")).alias("row_failures"),
    )


def identify(notices: DataFrame) -> DataFrame:
    """Add ``id`` and ``notice_key``; ``date`` stays as read, ids use its normal form."""
    return (
        notices.withColumn("_date", normalize_date(F.col("date")))
        .withColumn(
            "_digest",
            notice_digest(*[F.col(c) for c in
                            ("campus", "department_id", "board_id", "source_id", "link")]),
        )
        .withColumn("id", canonical_id(F.col("_date"), F.col("_digest")))
        .withColumn("notice_key", notice_key(F.col("_date"), F.col("_digest")))
        .drop("_date", "_digest")
    )


def rows_to_notices(rows: DataFrame) -> DataFrame:
    """Good rows as notices with source id and identity."""
    good = rows.filter("ok").withColumn("source_id", extract_notice_id(F.col("link")))
    return identify(good.withColumn("is_pinned", F.lit(False)))
