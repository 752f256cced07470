"""Reading the feed: filters, search, order, facets, summary, paging back by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.dates import iso_date, normalize_date

# White space a viewer strips from a query.
_QUERY_SPACE = "".join(
    map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)


def filter_exact(notices: DataFrame, column: str, value: str | None) -> DataFrame:
    """Exact, case-sensitive match; None or '' filters nothing."""
    return notices.filter(F.col(column) == value) if value else notices


def search_title(notices: DataFrame, query: str | None) -> DataFrame:
    """Titles containing the query as plain text, ignoring case; a blank query keeps all."""
    wanted = (query or "").strip(_QUERY_SPACE).lower()
    return notices.filter(F.contains(F.lower("title"), F.lit(wanted))) if wanted else notices


def apply_filters(
    notices: DataFrame,
    campus: str | None = None,
    department: str | None = None,
    board: str | None = None,
    search_query: str | None = None,
) -> DataFrame:
    notices = filter_exact(notices, "campus", campus)
    notices = filter_exact(notices, "department_name", department)
    notices = filter_exact(notices, "board_name", board)
    return search_title(notices, search_query)


def sort_by_date(
    notices: DataFrame, newest_first: bool = True, tie: tuple[str, ...] = ("notice_key",)
) -> DataFrame:
    """Date order with missing dates as ''. The tie columns make the order total and let the
    range sort split a day that holds most of the rows."""
    date = F.coalesce("date", F.lit(""))
    return notices.orderBy(date.desc() if newest_first else date.asc(), *tie)


def process_notices(
    notices: DataFrame,
    campus: str | None = None,
    department: str | None = None,
    board: str | None = None,
    search_query: str | None = None,
    limit: int | None = None,
    newest_first: bool = True,
    tie: tuple[str, ...] = ("notice_key",),
) -> DataFrame:
    """Filter, then newest first; with ``limit`` a top-k instead of a full sort."""
    found = sort_by_date(
        apply_filters(notices, campus, department, board, search_query), newest_first, tie
    )
    return found.limit(limit) if limit is not None else found


def facet(
    notices: DataFrame, column: str, campus: str | None = None, department: str | None = None
) -> DataFrame:
    """Sorted distinct values of a column, optionally below a campus and a department."""
    scoped = filter_exact(
        filter_exact(notices, "campus", campus), "department_name", department
    )
    return scoped.select(column).distinct().orderBy(column)


def facet_campuses(notices: DataFrame) -> DataFrame:
    return facet(notices, "campus")


def facet_departments(notices: DataFrame, campus: str | None = None) -> DataFrame:
    return facet(notices, "department_name", campus)


def facet_boards(
    notices: DataFrame, campus: str | None = None, department: str | None = None
) -> DataFrame:
    return facet(notices, "board_name", campus, department)


def facet_tree(notices: DataFrame) -> DataFrame:
    """All facet values at once, for a reader that drills down without new scans."""
    return notices.select("campus", "department_name", "board_name").distinct()


def notice_stats(notices: DataFrame) -> DataFrame:
    """One row: total and distinct campuses, departments, boards, colleges.

    Rows shrink to their distinct combinations first, so the distinct counts run on a small
    frame and no row is copied per counted column. NULL counts as one value.
    """
    dims = ["campus", "department_name", "board_name", "college"]
    combos = notices.groupBy(*dims).agg(F.count("*").alias("n"))
    # A value and a missing value must differ, hence the mark in front.
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in dims]
    campus, department, board, college = [F.count_distinct(m) for m in marked]
    return combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        campus.alias("campuses"),
        department.alias("departments"),
        board.alias("boards"),
        college.alias("colleges"),
    )


def date_range(notices: DataFrame) -> DataFrame:
    """One row: first and last non-empty date text, '' if there is none.

    Distinct dates first: that is a hash aggregation with few rows left for the string
    minimum and maximum.
    """
    dates = notices.select(F.nullif("date", F.lit("")).alias("date")).distinct()
    return dates.agg(
        F.coalesce(F.min("date"), F.lit("")).alias("earliest"),
        F.coalesce(F.max("date"), F.lit("")).alias("latest"),
    )


def latest_date(notices: DataFrame) -> DataFrame:
    return date_range(notices).select("latest")


def not_loaded(page: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of a month page whose (link, date) is not loaded yet; repeats inside the page
    stay."""
    seen = loaded.select("link", "date").distinct()
    return page.join(seen, ["link", "date"], "left_anti")


def _month_no(year, month):
    return year * 12 + month - 1


def backfill_months(hot: DataFrame, months: DataFrame, steps: int | None = None) -> list[tuple[int, int]]:
    """Months the reader pages back through: from the month before the oldest loaded date,
    ending at the first month without rows. Bounded by the calendar, hence a list."""
    oldest = hot.agg(F.min(iso_date(F.col("date"))).alias("d")).first()["d"]
    if oldest is None:
        return []
    have = {(r["year"], r["month"]) for r in months.select("year", "month").distinct().collect()}
    found: list[tuple[int, int]] = []
    number = _month_no(oldest.year, oldest.month) - 1
    while steps is None or len(found) < steps:
        period = (number // 12, number % 12 + 1)
        if period not in have:
            break
        found.append(period)
        number -= 1
    return found


def in_months(archive: DataFrame, periods: list[tuple[int, int]]) -> DataFrame:
    """Rows of the given months; the condition prunes ``year, month`` partitions."""
    if not periods:
        return archive.limit(0)
    by_year: dict[int, list[int]] = {}
    for year, month in periods:
        by_year.setdefault(year, []).append(month)
    keep = F.lit(False)
    for year, months in sorted(by_year.items()):
        keep = keep | ((F.col("year") == year) & F.col("month").isin(sorted(months)))
    return archive.filter(keep)


def month_backfill(hot: DataFrame, archive: DataFrame, steps: int | None = None) -> DataFrame:
    """Hot rows plus the archive months behind them, as a reader paging back collects them.

    Page 0 is hot; ``page`` counts months back. A row is left out if an earlier page has its
    (link, date): the earliest page per pair is found by a map-side minimum, so a pair that
    fills a third of the rows is one row per task before the shuffle.
    """
    periods = backfill_months(hot, archive, steps)
    if not periods:
        return hot.withColumn("page", F.lit(0))
    newest = _month_no(*periods[0])
    older = in_months(archive, periods).withColumn(
        "page", F.lit(newest + 1) - _month_no(F.col("year"), F.col("month"))
    )
    shared = [c for c in hot.columns if c in older.columns]
    pages = (
        hot.select(*shared).withColumn("page", F.lit(0)).unionByName(older.select(*shared, "page"))
    )
    first = pages.groupBy("link", "date").agg(F.min("page").alias("page"))
    # Rows without a link or a date are pairs like any other.
    same = [pages[c].eqNullSafe(first[c]) for c in ("link", "date", "page")]
    return pages.join(first, same, "left_semi")


def to_nested(notices: DataFrame) -> DataFrame:
    """Stored form: id, title, link and a metadata struct, the date normalised."""
    return notices.select(
        "id",
        "title",
        "link",
        F.struct(
            "campus",
            "college",
            "department_name",
            "board_name",
            normalize_date(F.col("date")).alias("date"),
            F.col("is_pinned").alias("pinned"),
        ).alias("metadata"),
    )


def to_flat(nested: DataFrame) -> DataFrame:
    return nested.select("id", "title", "link", "metadata.*").withColumnRenamed(
        "pinned", "is_pinned"
    )
