"""Fetched pages: the table of pages, and which fetches count as a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from noticelake.schemas import PAGES
from noticelake.session import bound_batches, spread

MAX_BODY_BYTES = 2_000_000
TRANSPORT_ERRORS = ("timeout", "connect", "request")


def read_pages(spark: SparkSession, path: str, stream: bool = False, fetched: bool = False) -> DataFrame:
    """Pages ``(page_id, url, html)``, with ``fetched`` also the time of the fetch.

    A URL may have several rows; jobs read the last fetch, or the largest page id where times are
    not stored.
    """
    schema = StructType([*PAGES, StructField("fetched_at", TimestampType())]) if fetched else PAGES
    if stream:
        return spark.readStream.schema(schema).parquet(path)
    bound_batches(spark)
    return spread(spark.read.schema(schema).parquet(path))


def fetch_outcome(
    status: Column, content_type: Column, length: Column, transport_error: Column
) -> Column:
    """First rule that applies decides. A missing header passes its rule."""
    html = content_type.contains("text/html") | content_type.contains("application/xhtml+xml")
    return (
        F.when(transport_error.isNotNull(), "transport")
        .when(status == 304, "not_modified")
        .when(~status.between(200, 299), "upstream_http")
        .when(content_type.isNotNull() & ~html, "unexpected_content_type")
        .when(length > MAX_BODY_BYTES, "body_too_large")
        .otherwise("ok")
    )


def fetch_retryable(outcome: Column, status: Column, transport_error: Column) -> Column:
    """Server errors, throttling and transport faults may be tried again; nothing else."""
    http = (outcome == "upstream_http") & (status.between(500, 599) | (status == 429))
    transport = (outcome == "transport") & transport_error.isin(*TRANSPORT_ERRORS)
    return F.coalesce(http | transport, F.lit(False))


def classify_fetch(
    fetches: DataFrame,
    status: str = "status",
    content_type: str = "content_type",
    length: str = "content_length",
    transport_error: str = "transport_error",
) -> DataFrame:
    """Add ``outcome`` and ``retryable`` to a fetch log."""
    s, t = F.col(status), F.col(transport_error)
    return fetches.withColumn(
        "outcome", fetch_outcome(s, F.col(content_type), F.col(length), t)
    ).withColumn("retryable", fetch_retryable(F.col("outcome"), s, t))
