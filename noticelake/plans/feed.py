"""The read job: hot month, months behind it, filters, order, facets, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from noticelake.operators import feed as fd
from noticelake.sources.lake import NoticeLake


@dataclass(frozen=True)
class Feed:
    """Lazy frames of one read. Summary and facets cover all loaded rows, not the filtered."""

    loaded: DataFrame
    notices: DataFrame
    stats: DataFrame
    latest: DataFrame
    campuses: DataFrame
    departments: DataFrame
    boards: DataFrame


def feed(
    spark: SparkSession,
    root: str,
    campus: str | None = None,
    department: str | None = None,
    board: str | None = None,
    search_query: str | None = None,
    months_back: int | None = 0,
    limit: int | None = None,
    newest_first: bool = True,
) -> Feed:
    """Feed of the last committed run, paged back ``months_back`` months (None: to the first
    gap)."""
    lake = NoticeLake(spark, root)
    hot = lake.read_current()
    loaded = hot if months_back == 0 else fd.month_backfill(hot, lake.archive(), months_back)
    return Feed(
        loaded=loaded,
        notices=fd.process_notices(
            loaded, campus, department, board, search_query, limit, newest_first
        ),
        stats=fd.notice_stats(loaded),
        latest=fd.latest_date(loaded),
        campuses=fd.facet_campuses(loaded),
        departments=fd.facet_departments(loaded, campus),
        boards=fd.facet_boards(loaded, campus, department),
    )
