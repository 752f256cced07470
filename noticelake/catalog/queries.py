"""One Spark query per operator, over whole tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticelake.catalog import views as v
from noticelake.config import (
    SHIPPED_CLEANING,
    Breaker,
    Cleaning,
    CmsPattern,
    CommitOptions,
    Config,
    Discovery,
    IndexRules,
    Keyword,
    Selectors,
)
from noticelake.functions import dates, ids, text, urls
from noticelake.functions.text import tokenize
from noticelake.operators import departments as dep
from noticelake.operators import feed as fd
from noticelake.operators import index as ix
from noticelake.operators import links as ln
from noticelake.operators import rows as rw
from noticelake.operators import snapshot as sn
from noticelake.operators import stats as st
from noticelake.operators.dedupe import dedupe_first, first_per_key, id_collisions, with_html
from noticelake.plans.commit import commit_snapshot, merge_archive
from noticelake.plans.crawl import run_crawl
from noticelake.plans.feed import feed
from noticelake.plans.map_sites import run_map
from noticelake.plans.run import run_pipeline
from noticelake.schemas import BOARDS, NOTICES
from noticelake.session import scratch_path, spread
from noticelake.sources import sitemap as sm
from noticelake.sources.html_nodes import extract_elements
from noticelake.sources.lake import ARCHIVE, NoticeLake
from noticelake.sources.pages import classify_fetch, read_pages
from noticelake.streaming.incremental import exact_feed, incremental_commit, new_notice_feed, normalize_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


FEED_COLUMNS = ["id", "title", "campus", "department_name", "board_name", "date", "link"]


# Feed reads


@query
def q01_feed(spark, d):
    found = fd.process_notices(
        v.notices(spark, d), "ASIA", "BUILDING", "1-URGENT", "  F Notice ", limit=100
    )
    return found.select(*FEED_COLUMNS)


@query
def q01b_feed_asc(spark, d):
    found = fd.process_notices(
        v.notices(spark, d), campus="EUROPE", limit=100, newest_first=False
    )
    return found.select(*FEED_COLUMNS)


@query
def q01c_search_title(spark, d):
    return fd.search_title(v.notices(spark, d), "O NOTICE 1").select("notice_key", "title")


@query
def q01d_apply_filters(spark, d):
    found = fd.apply_filters(v.notices(spark, d), campus="AMERICA", board="5-LOW", department="")
    return found.groupBy("campus", "department_name", "board_name").agg(
        F.count("*").alias("notices")
    )


@query
def q02_facets(spark, d):
    n = v.raw_notices(spark, d)
    parts = {
        "campus": fd.facet_campuses(n),
        "department": fd.facet_departments(n, "ASIA"),
        "board": fd.facet_boards(n, "ASIA", "MACHINERY"),
        "all departments": fd.facet_departments(n),
    }
    frames = [f.select(F.lit(k).alias("facet"), F.col(f.columns[0]).alias("value"))
              for k, f in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


@query
def q02b_facet_tree(spark, d):
    return fd.facet_tree(v.raw_notices(spark, d))


@query
def q03_notice_stats(spark, d):
    return fd.notice_stats(v.raw_notices(spark, d))


@query
def q03b_date_range(spark, d):
    return fd.date_range(v.notices(spark, d))


@query
def q03c_latest_date(spark, d):
    return fd.latest_date(v.notices(spark, d))


# Scalars over whole tables


@query
def q04_normalize_dates(spark, d):
    raw = F.col("raw_date")
    return v.raw_notices(spark, d).select(
        "row_pos",
        dates.normalize_date(raw).alias("date"),
        dates.archive_year(dates.normalize_date(raw), v.AS_OF).cast("long").alias("year"),
        dates.archive_month(dates.normalize_date(raw), v.AS_OF).cast("long").alias("month"),
        dates.normalize_date(raw, strip_trailing_sep=True).alias("date_stripped"),
    )


@query
def q05_canonical_id(spark, d):
    return v.notices(spark, d).select(
        "row_pos", "id", "notice_key", ids.extract_notice_id(F.col("link")).alias("link_id")
    )


@query
def q05b_id_collisions(spark, d):
    return id_collisions(v.notices(spark, d))


def _with_copies(spark, d) -> DataFrame:
    """All notices plus a second listing in which filled orders lose link number and date, so
    that few identities hold a third of the second listing."""
    raw = v.raw_notices(spark, d)
    filled = F.col("status") == "F"
    copy = (
        raw.withColumn("source_id", F.when(filled, "").otherwise(F.col("source_id")))
        .withColumn(
            "link",
            F.when(filled, F.concat(F.lit("https://example.com/"), F.lower("college"))).otherwise(
                F.col("link")
            ),
        )
        .withColumn("raw_date", F.when(filled, "2001-01-01").otherwise(F.col("raw_date")))
        .withColumn("raw_title", F.concat(F.lit("copy "), "raw_title"))
    )
    both = raw.withColumn("board_ord", F.lit(0)).unionByName(copy.withColumn("board_ord", F.lit(1)))
    return v.prepare(both)


@query
def q06_dedupe_first(spark, d):
    kept = dedupe_first(_with_copies(spark, d).filter(text.has_title(F.col("title"))))
    return kept.select("notice_key", "title", "board_ord", "row_pos")


# Runs compared


def _two_runs(spark, d) -> tuple[DataFrame, DataFrame]:
    n = v.notices(spark, d)
    return v.earlier_run(n), v.later_run(n)


@query
def q07_change_feed(spark, d):
    before, now = _two_runs(spark, d)
    return sn.change_feed(before, now).select("change", "notice_key", "id", "title", "campus")


@query
def q07b_change_counts(spark, d):
    return sn.change_counts(sn.change_feed(*_two_runs(spark, d)))


@query
def q07c_change_feed_without_updates(spark, d):
    changes = sn.change_feed(*_two_runs(spark, d), detect_updates=False)
    return changes.groupBy("change").agg(F.count("*").alias("notices"))


@query
def q07d_unchanged_ids(spark, d):
    return sn.unchanged_ids(*_two_runs(spark, d))


@query
def q07e_only_in_current(spark, d):
    before, now = _two_runs(spark, d)
    return sn.only_in(now, before).select("notice_key", "title")


@query
def q08_circuit_breaker(spark, d):
    n, region, nation = v.raw_notices(spark, d), v.table(spark, d, "region"), v.table(spark, d, "nation")
    pairs = {
        "all, all": (n, n),
        "part of it": (n.filter("true_date >= '1995-07-01'"), n),
        "two of three states": (n.filter("status <> 'F'"), n),
        "nothing": (n.filter("status = 'X'"), n),
        "more": (n, n.filter("status <> 'F'")),
        "small baseline": (nation, region),
        "first run": (n, n.filter("status = 'X'")),
        "both empty": (n.filter("status = 'X'"), n.filter("status = 'Y'")),
    }
    result = None
    for name, (now, before) in pairs.items():
        verdict = sn.circuit_breaker(now, before).select(
            F.lit(name).alias("pair"),
            "current_count",
            "previous_count",
            "status",
            F.round("drop_percent", 6).alias("drop_percent"),
            "proceed",
        )
        result = verdict if result is None else result.unionByName(verdict)
    return result


@query
def q09_month_partition(spark, d):
    counted = sn.month_counts(sn.month_partition(v.notices(spark, d), v.AS_OF))
    return counted.select(
        F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"),
        "is_hot", "notices",
    )


def _stored(spark, frame: DataFrame) -> DataFrame:
    """The frame as a written table: an operator that reads its input more than once does not
    compute it again."""
    path = scratch_path(spark, "stored")
    frame.write.parquet(path, compression="zstd")
    return spark.read.schema(frame.schema).parquet(path)


def _cold(spark, n: DataFrame) -> DataFrame:
    return sn.month_partition(n, v.AS_OF).filter(~F.col("is_hot")).select(*ARCHIVE.names)


@query
def q10_archive_merge(spark, d):
    lake = NoticeLake(spark, scratch_path(spark, "archive"))
    n = _stored(spark, v.notices(spark, d))
    folders = []
    for part, run in (("r1", v.earlier_run(n)), ("r2", v.later_run(n))):
        _, folders = merge_archive(_cold(spark, run), lake, part, folders)
    return lake.archive(folders).select(
        "notice_key", "title",
        F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"),
    )


@query
def q10b_read_archives(spark, d):
    lake = NoticeLake(spark, scratch_path(spark, "archive"))
    commit_snapshot(spark, _stored(spark, v.notices(spark, d)), lake.root, "r1", v.AS_OF,
                    CommitOptions(calculate_diff=False, generate_index=False))
    read = lake.read_archives([(2001, 6), (2001, 5), (1901, 1)]).unionByName(
        lake.read_archive(2000, 12)
    )
    return read.select("notice_key", "date", "title")


@query
def q11_month_backfill(spark, d):
    parts = _stored(spark, sn.month_partition(v.notices(spark, d), v.AS_OF))
    # Newest pages also list what the month before already had.
    hot = parts.filter("is_hot OR (year = 2001 AND month = 6 AND status = 'F')")
    pages = fd.month_backfill(hot, parts.filter(~F.col("is_hot")))
    return pages.select("notice_key", "date", F.col("page").cast("long").alias("page"))


@query
def q11b_load_month(spark, d):
    n = v.notices(spark, d)
    return fd.not_loaded(v.later_run(n), v.earlier_run(n)).select("notice_key", "title")


# Index


def _part_notices(spark, d) -> DataFrame:
    p = v.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_partkey").cast("string").alias("notice_key"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("campus"),
        F.col("p_brand").alias("department_name"),
        F.lit("the board").alias("board_name"),
        F.lit("").alias("college"),
    )


def _document_notices(spark, d) -> DataFrame:
    doc = spread(v.table(spark, d, "documents"))
    return doc.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").cast("string").alias("notice_key"),
        F.regexp_replace("text", r"[^\p{L}\p{Nd}]+", " ").alias("title"),
        F.col("lang").alias("campus"),
        F.col("source").alias("department_name"),
        F.lit("").alias("board_name"),
        F.lit("").alias("college"),
    )


@query
def q12_inverted_index(spark, d):
    return ix.sorted_postings(ix.build_postings(_part_notices(spark, d))).select("token", "id")


@query
def q12b_index_documents(spark, d):
    return ix.build_postings(_document_notices(spark, d)).select("token", "id")


@query
def q12c_document_frequency(spark, d):
    rules = IndexRules(metadata=False)
    return ix.document_frequency(ix.build_postings(_document_notices(spark, d), rules))


@query
def q12d_index_header(spark, d):
    n = _part_notices(spark, d)
    return ix.index_header(ix.build_postings(n), n)


@query
def q12e_export_index(spark, d):
    blocks = ix.export_index(ix.build_postings(_part_notices(spark, d)))
    return blocks.select("token", "doc_freq", F.array_join("ids", ",").alias("ids"))


@query
def q12f_long_tokens(spark, d):
    """The numbers of each document joined by commas, 2,000 times over: one very long word."""
    doc = v.table(spark, d, "documents")
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    joined = doc.select("doc_id", numbers.alias("n")).filter(F.size("n") > 0)
    words = joined.select(
        "doc_id", tokenize(F.repeat(F.concat(F.array_join("n", ","), F.lit(",")), 2000)).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("words"),
                        F.length(F.get("w", F.lit(0))).cast("long").alias("length"))


@query
def q12g_capped_tokens(spark, d):
    rules = IndexRules(max_tokens=50)
    return ix.build_postings(_document_notices(spark, d), rules).select("token", "id")


@query
def q13b_search_stored_index(spark, d):
    """Search over the postings that a commit stored."""
    lake = NoticeLake(spark, scratch_path(spark, "lake"))
    n = _stored(spark, v.notices(spark, d))
    commit_snapshot(spark, n.select(*NOTICES.names), lake.root, "r1", v.AS_OF, CommitOptions(calculate_diff=False))
    found = ix.search_notices(lake.read_index(), lake.read_snapshot(), "notice asia building")
    return found.select("notice_key", "title")


@query
def q13c_search_three_runs(spark, d):
    """Search over the layers that three commits stored: of the second run few notices differ from
    the first, of the third most."""
    lake = NoticeLake(spark, scratch_path(spark, "lake"))
    n = _stored(spark, v.notices(spark, d)).select("true_date", *NOTICES.names)
    before = v.earlier_run(n)
    retitled = F.when(F.col("true_date") >= "2000-10-01", F.lit("notice of other words")).otherwise(F.col("title"))
    runs = {"r1": before, "r2": before.filter("true_date >= '1992-03-01'").withColumn("title", retitled),
            "r3": v.later_run(n)}
    options = CommitOptions(force=True)
    found = []
    for run_id, run in runs.items():
        commit_snapshot(spark, run.drop("true_date"), lake.root, run_id, v.AS_OF, options, stored=True)
        for text in ("changed notice asia", "other words building"):
            hits = ix.search_ids(lake.read_index(), text)
            found.append(hits.select(F.lit(run_id).alias("run_id"), F.lit(text).alias("query"), "notice_key"))
    return reduce(DataFrame.unionByName, found)


@query
def q13_index_search(spark, d):
    n = _part_notices(spark, d)
    return ix.search_notices(ix.build_postings(n), n, "the Small RING").select("id", "title")


# Pages and links


def _pages(spark, d) -> DataFrame:
    return read_pages(spark, f"{d}/pages.parquet")


@query
def q14_extract_links(spark, d):
    return ln.extract_links(_pages(spark, d)).select("page_id", "pos", "text", "href", "link_url")


@query
def q14b_link_rules(spark, d):
    links = ln.extract_links(_pages(spark, d))
    return links.select(
        "page_id",
        "pos",
        ln.href_not_blacklisted(F.col("href"), ("the", "/de")).alias("listed"),
        ln.link_text_max_len(F.col("text"), 5).alias("short"),
        ln.navigable_href(F.col("href")).alias("navigable"),
        ln.same_host(F.col("url"), F.col("link_url")).alias("same_host"),
        urls.host(F.col("link_url")).alias("host"),
    )


# Test settings: frequent words of the pages stand in for board names.
_RULES = Discovery(
    max_link_text=12,
    blacklist=("tion", "/st"),
    keywords=(
        Keyword("the", "academic", "Academic"),
        Keyword("en", "notice", "Notices"),
        Keyword("in", "notice", "Notices"),
        Keyword("a", "career", "Career"),
    ),
    patterns=(
        CmsPattern("paged", Selectors("ul li", "a", "a"), url_contains="page="),
        CmsPattern("quoted", Selectors("li:has(a)", "li a", "a"), html_contains="$$$ "),
        CmsPattern("french", Selectors("nav li", "a", "a"), url_contains="/fr/",
                   html_contains='LANG="FR"'),
    ),
)


@query
def q14c_board_links(spark, d):
    links = ln.board_links(ln.extract_links(_pages(spark, d)), _RULES)
    return links.select("page_id", "pos", "text", "href")


@query
def q14d_elements(spark, d):
    e = extract_elements(_pages(spark, d)).filter("tag IN ('a', 'li', 'h1', 'ul', 'nav')")
    return e.groupBy("page_id", "tag").agg(
        F.count("*").alias("elements"), F.sum(F.length("text")).alias("text_length")
    )


@query
def q15_dedupe_links(spark, d):
    links = ln.extract_links(_pages(spark, d)).withColumn("host", urls.host(F.col("url")))
    per_site = first_per_key(links, ["host", "link_url"], ["page_id", "pos"])
    return per_site.select("host", "href", "page_id", "pos")


@query
def q16_keyword_boards(spark, d):
    links = ln.board_links(ln.extract_links(_pages(spark, d)), _RULES)
    boards = ln.keyword_boards(links, _RULES, ["page_id"])
    return boards.select("page_id", "pos", "board_id", "board_name")


@query
def q17_detect_cms(spark, d):
    found = ln.detect_cms(F.col("url"), F.col("html"), _RULES.patterns)
    return _pages(spark, d).select(
        "page_id", found["cms"].alias("cms"), found["selectors"]["row_selector"].alias("row_selector")
    )


@query
def q17b_resolve_selectors(spark, d):
    pages = _pages(spark, d)
    own = ln.detect_cms(F.col("url"), F.col("html"), _RULES.patterns[:1])["selectors"]
    boards = pages.select("page_id", F.col("url").alias("board_url"), own.alias("detected"))
    chosen = ln.resolve_selectors(boards, pages, _RULES)
    return chosen.select("page_id", "row_selector", "title_selector", "date_selector", "attr_name")


@query
def q19_merge_sources(spark, d):
    links = ln.extract_links(_pages(spark, d)).withColumn("host", urls.host(F.col("url")))
    boards = links.select(
        "host",
        F.col("link_url").alias("board_url"),
        F.when(F.col("url").startswith("https"), 0).otherwise(1).alias("source_prio"),
        (F.col("page_id") * 1000 + F.col("pos")).alias("pos"),
        "href",
    )
    merged = ln.merge_boards(boards, ["host"])
    return merged.select("host", "href", F.col("source_prio").cast("long").alias("source_prio"), "pos")


@query
def q20_classify_fetch(spark, d):
    return classify_fetch(v.attempts(spark, d)).select("event_id", "outcome", "retryable")


@query
def q21_run_stats(spark, d):
    log = classify_fetch(v.attempts(spark, d))
    totals = log.groupBy("event_type").agg(
        F.count("*").alias("board_total"),
        F.count_if(F.col("outcome") != "ok").alias("board_failures"),
    )
    return st.with_rates(totals, ("board",)).withColumn(
        "board_success_rate", F.round("board_success_rate", 9)
    )


@query
def q21b_error_report(spark, d):
    log = classify_fetch(v.attempts(spark, d)).filter("outcome <> 'ok'")
    return st.error_report(log.withColumn("stage", F.lit("board_list")))


@query
def q21c_board_lookup(spark, d):
    n = v.notices(spark, d)
    known = v.earlier_run(n).filter("campus <> 'ASIA'").select("campus", "department_id", "board_id")
    return st.board_lookup_errors(n, known).select("stage", "notice_id", "message", "retryable")


def _hierarchy(spark, d) -> tuple[DataFrame, DataFrame]:
    """Departments and boards of the notices; buildings hang directly below the campus."""
    n = v.raw_notices(spark, d).withColumn(
        "college", F.when(F.col("department_id") == "BUILDING", "").otherwise(F.col("college"))
    )
    key = ["campus", "college", "department_id", "department_name"]
    url = F.concat_ws("/", F.lit("https://example.com"), *key[:3])
    departments = n.select(*key).distinct().select(
        *key, url.alias("department_url"),
        F.dense_rank().over(Window.partitionBy("campus").orderBy("college", "department_id"))
        .cast("long").alias("department_ord"),
    )
    boards = n.select(*key, "board_id", "board_name").distinct().select(
        *key, url.alias("department_url"),
        F.substring("board_id", 1, 1).cast("long").alias("board_ord"),
        "board_id", "board_name", F.concat_ws("/", url, "board_id").alias("board_url"),
        ln.selector_columns(_RULES.fallback).alias("s"),
    ).select("*", "s.*").drop("s")
    return departments, boards


@query
def q22_hierarchy(spark, d):
    path = scratch_path(spark, "sitemap")
    sm.write_sitemap(*_hierarchy(spark, d), path)
    flat = sm.flatten_boards(sm.read_sitemap(spark, path, lines=True))
    return flat.select("campus", "college", "department_id", "board_id", "board_url",
                       "row_selector", "attr_name", "author_selector")


@query
def q22b_hierarchy_counts(spark, d):
    return st.hierarchy_counts(_hierarchy(spark, d)[1])


@query
def q22c_nested_notices(spark, d):
    nested = fd.to_nested(v.notices(spark, d))
    return fd.to_flat(nested)


_DOC_RULES = Cleaning(title_removals=("the ", "on"), date_removals=("an",),
                      date_replacements=((". ", "."), (",", ";")))


@query
def q23_clean_text(spark, d):
    t = F.col("text")
    return spread(v.table(spark, d, "documents")).select(
        "doc_id",
        F.md5(text.normalize_ws(t)).alias("normalized"),
        F.md5(text.clean_title(t, _DOC_RULES)).alias("title"),
        F.md5(text.clean_date(t, _DOC_RULES)).alias("date"),
        F.md5(text.clean_header(t, ("the", "ing"))).alias("header"),
    )


@query
def q24_manual_review(spark, d):
    pages = _pages(spark, d)
    url = F.col("url")
    departments = pages.select(
        urls.host(url).alias("campus"),
        F.lit("").alias("college"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("department_name"),
        F.when(url.contains("/fr/"), F.concat(url, F.lit("/gone")))
        .when(url.contains("/de/"), "NOT_FOUND")
        .when(url.contains("/es/"), F.concat(F.lit("ftp:"), url))
        .otherwise(url)
        .alias("department_url"),
        "page_id",
    )
    links = ln.board_links(ln.extract_links(pages), _RULES)
    boards = ln.keyword_boards(links, _RULES, ["page_id"]).join(
        departments.drop("department_url"), "page_id"
    )
    return dep.manual_review(departments, pages, boards)


@query
def q24b_departments_of_urls(spark, d):
    return _pages(spark, d).select(
        "page_id",
        dep.valid_department_url(F.col("url")).alias("valid"),
        ids.department_id(F.concat(F.lit("Page No "), F.col("page_id").cast("string")),
                          F.col("url"), "dept", "example.com").alias("department_id"),
    )


@query
def q26_extract_rows(spark, d):
    return rw.rows_to_notices(_listing_rows(spark, d)).select(
        "department_id", "row_pos", "title", "date", "author", "link"
    )


@query
def q26b_row_accounting(spark, d):
    return rw.row_accounting(_listing_rows(spark, d)).select(
        "department_id", "row_total", "row_failures"
    )


def _page_boards(spark, d) -> DataFrame:
    """Every page as a board; French pages have an unknown selector, German ones a wrong
    optional one."""
    url = F.col("url")
    bad = F.when(url.contains("/fr/"), "nav::li").otherwise("nav li:has(a)")
    return _pages(spark, d).select(
        urls.host(url).alias("campus"),
        F.lit("").alias("college"),
        F.col("page_id").cast("string").alias("department_id"),
        F.lit("pages").alias("department_name"),
        F.lit(0).cast("long").alias("board_ord"),
        F.lit("list").alias("board_id"),
        F.lit("List").alias("board_name"),
        url.alias("board_url"),
        bad.alias("row_selector"),
        F.lit("ul a").alias("title_selector"),
        F.lit("a:last-child").alias("date_selector"),
        F.when(url.contains("/de/"), "a:hover").otherwise("li").alias("author_selector"),
        F.lit("href").alias("attr_name"),
        F.lit(None).cast("string").alias("link_selector"),
        "html",
    )


def _listing_rows(spark, d) -> DataFrame:
    boards = rw.check_selectors(_page_boards(spark, d)).filter("invalid_selector IS NULL")
    return rw.extract_notice_rows(boards, Cleaning(title_removals=("the", "de"))).drop("author_selector")


@query
def q14e_resolve_pages(spark, d):
    """Links of unusual forms against every page's URL with a user and the scheme's own port."""
    pages = v.table(spark, d, "pages").select("page_id", "url")
    base = F.regexp_replace("url", "^(https?)://([^/?#]*)", "$1://User:pw@$2")
    base = F.when(F.col("url").startswith("https"), F.regexp_replace(base, "@([^/?#]*)", "@$1:443")).otherwise(
        F.regexp_replace(base, "@([^/?#]*)", "@$1:80"))
    n = F.col("page_id").cast("string")
    hrefs = F.array(F.concat(F.lit("\\c\\d"), n), F.concat(F.lit("x?q={"), n, F.lit("}'")),
                    F.concat(F.split("url", ":")[0], F.lit(":y"), n), F.lit("{a}`#{b}`"))
    return pages.select("page_id", base.alias("base"), F.posexplode(hrefs).alias("form", "href")).select(
        "page_id", "form", urls.resolve_url(F.col("base"), F.col("href")).alias("link"))


@query
def q26d_selector_forms(spark, d):
    """The rows of q26 by selectors with attributes, ids, combinators and lists."""
    boards = rw.check_selectors(_page_boards(spark, d).withColumns({
        "row_selector": F.when(F.col("row_selector") == "nav::li", F.col("row_selector")).otherwise(
            "nav > ul > li:has([href]), #none ~ li"),
        "title_selector": F.lit("ul > li > [href^='/'], i + b"),
        "date_selector": F.lit("li > a:last-child:not([data-x='1'])"),
        "author_selector": F.when(F.col("author_selector") == "li", "nav ul > li")})).filter("invalid_selector IS NULL")
    rows = rw.extract_notice_rows(boards, Cleaning(title_removals=("the", "de"))).drop("author_selector")
    return rw.rows_to_notices(rows).select("department_id", "row_pos", "title", "date", "author", "link")


@query
def q26c_selector_errors(spark, d):
    errors = rw.selector_errors(_page_boards(spark, d).drop("html"))
    return errors.select("stage", "url", "message", "retryable")


# Jobs


def _commit_runs(spark, d, root: str) -> None:
    n = _stored(spark, v.notices(spark, d))
    runs = {"r1": v.earlier_run(n), "r2": v.later_run(n).filter("status = 'F'"), "r3": v.later_run(n)}
    for run_id, run in runs.items():
        commit_snapshot(spark, run, root, run_id, v.AS_OF)


@query
def q27_commit(spark, d):
    root = scratch_path(spark, "lake")
    _commit_runs(spark, d, root)
    return NoticeLake(spark, root).manifest().select(
        "run_id", "seq", "status", "committed", "current_count", "previous_count",
        F.round("drop_percent", 6).alias("drop_percent"), "hot_count", "cold_months",
        "added", "updated", "removed", "index_notice_count", "index_token_count",
    )


@query
def q27c_rollover(spark, d):
    """The archive after two runs in different months, with a run between them that died before
    its manifest row, and every month rewritten by the second."""
    lake = NoticeLake(spark, scratch_path(spark, "lake"))
    n = _stored(spark, v.notices(spark, d))
    options = CommitOptions(calculate_diff=False, generate_index=False)
    commit_snapshot(spark, v.earlier_run(n), lake.root, "r1", "2000-12-10", options)
    dead = v.later_run(n).withColumn("title", F.lit("of a run that died"))
    merge_archive(_cold(spark, dead), lake, "r2", lake.archive_folders(), most=1)
    commit_snapshot(spark, v.later_run(n), lake.root, "r3", v.AS_OF, options)
    return lake.archive().select(
        "notice_key", "title",
        F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


@query
def q27b_feed_after_commit(spark, d):
    root = scratch_path(spark, "lake")
    _commit_runs(spark, d, root)
    read = feed(spark, root, campus="ASIA", months_back=None)
    return read.notices.select("notice_key", "title", "date")


def _site_config(spark, d) -> tuple[Config, DataFrame, DataFrame, str]:
    """The derived web, written once: jobs read pages from storage, not from their making."""
    path = scratch_path(spark, "site")
    v.site_pages(spark, d).write.parquet(path, compression="zstd")
    config = Config(cleaning=SHIPPED_CLEANING)
    return config, v.site_seeds(spark, d), read_pages(spark, path), path


@query
def q18_heading_segments(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    seed_pages = with_html(seeds, pages, "url")
    elements = dep.heading_elements(seed_pages.select("campus", "html"), key="campus")
    found = dep.segment_headings(elements, config.discovery, key="campus")
    return found.select("campus", "college", "department", "url")


@query
def q28_map_departments(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    found = run_map(seeds, pages, config)
    return found.departments.drop("department_ord")


@query
def q28b_map_boards(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    found = run_map(seeds, pages, config)
    return found.boards.select("campus", "college", "department_id", "board_id", "board_name",
                               "board_url", "row_selector")


@query
def q28c_map_reviews(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    return run_map(seeds, pages, config).reviews


@query
def q28d_crawl_notices(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    boards = run_map(seeds, pages, config).boards
    return run_crawl(boards.select(*BOARDS.names), pages, config).notices.drop("is_pinned", "author")


@query
def q28g_repeated_pages(spark, d):
    """q28d over pages that are all stored twice, the older fetch cut in half."""
    config, seeds, pages, _ = _site_config(spark, d)
    old = pages.select(F.xxhash64("url", F.lit("old")).alias("page_id"), "url",
                       F.expr("substr(html, 1, CAST(length(html) / 2 AS INT))").alias("html"))
    path = scratch_path(spark, "fetches")
    pages.withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp")).unionByName(
        old.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))).write.parquet(
            path, compression="zstd")
    twice = read_pages(spark, path, fetched=True)
    boards = run_map(seeds, twice, config).boards
    return run_crawl(boards.select(*BOARDS.names), twice, config).notices.drop("is_pinned", "author")


@query
def q28e_crawl_outcome(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    boards = run_map(seeds, pages, config).boards
    return st.with_rates(run_crawl(boards.select(*BOARDS.names), pages, config).outcome)


@query
def q21d_stored_errors(spark, d):
    """Errors of a run as the lake holds them: listings without a page, and boards with a row selector nobody can read."""
    config, seeds, pages, _ = _site_config(spark, d)
    boards = run_map(seeds, pages, config).boards.select(*BOARDS.names)
    broken = F.when(F.contains("row_selector", F.lit("td-subject")), "tr:hover").otherwise(F.col("row_selector"))
    boards = _stored(spark, boards.withColumn("row_selector", broken))
    result = run_crawl(boards, pages, config)
    root = scratch_path(spark, "lake")
    commit_snapshot(spark, result.notices, root, "r1", v.AS_OF, errors=result.errors, stored=True)
    return NoticeLake(spark, root).read_errors().select(
        "stage", "board_id", "board_name", "url", "message", "retryable")


@query
def q28h_missing_links(spark, d):
    """Boards whose rows lack a link: every notice with a number that ends in 5 has lost its href."""
    config, seeds, pages, _ = _site_config(spark, d)
    path = scratch_path(spark, "unlinked")
    lost = F.regexp_replace("html", r'href="([^"]*view/[0-9]*5)"', "name='$1'")
    pages.withColumn("html", lost).write.parquet(path, compression="zstd")
    pages = read_pages(spark, path)
    boards = _stored(spark, run_map(seeds, pages, config).boards.select(*BOARDS.names))
    return run_crawl(boards, pages, config).missing_links.drop("board_url")


@query
def q28f_full_run(spark, d):
    config, seeds, pages, _ = _site_config(spark, d)
    root = scratch_path(spark, "lake")
    run_pipeline(spark, seeds, pages, root, "r1", v.AS_OF, config)
    # The second run reuses the stored boards and finds nothing new.
    run_pipeline(spark, None, pages, root, "r2", v.AS_OF, config, skip_map=True)
    lake = NoticeLake(spark, root)
    stats = lake.read_run_stats().select("run_id", "department_count", "board_count", "notice_total")
    return lake.manifest().join(stats, "run_id").select(
        "run_id", "status", "current_count", "added", "updated", "removed",
        "department_count", "board_count", "notice_total",
    )


# Streams


def _stream_table(spark, d, name: str) -> DataFrame:
    """A given table as a stream. The pattern also fits a table that is a single file."""
    schema = v.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query
def q25_stream_new_notices(spark, d):
    work = scratch_path(spark, "stream")
    events = _stream_table(spark, d, "events")
    # The horizon spans the whole table here, so the result is exact.
    fresh = new_notice_feed(events, ("user_id", "event_type"), "ts", "3650 days")
    fresh.select("user_id", "event_type").writeStream.format("parquet").option(
        "checkpointLocation", f"{work}/state"
    ).trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{work}/out")


@query
def q25e_exact_feed(spark, d):
    """Keys with the batch that first had them; three batches that repeat keys in themselves and of each other."""
    work = scratch_path(spark, "stream")
    events = v.table(spark, d, "events").select("event_id", F.concat_ws(
        ":", "user_id", "event_type", F.floor("value").cast("string")).alias("key"))
    for batch in range(3):
        events.filter(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{work}/in")
        stream.writeStream.foreachBatch(exact_feed(f"{work}/out", f"{work}/seen", "key")).option(
            "checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, batch long").parquet(f"{work}/out")


@query
def q25b_stream_normalize(spark, d):
    work = scratch_path(spark, "stream")
    orders = _stream_table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    raw = orders.select(
        F.col("o_orderpriority").alias("board_id"),
        F.col("o_orderstatus").alias("department_id"),
        F.lit("stream").alias("campus"),
        F.concat(F.lit(" a  notice "), key).alias("raw_title"),
        F.date_format("o_orderdate", "yy.M.d").alias("raw_date"),
        F.concat(F.lit("https://example.com/list?seq="), key).alias("link"),
    )
    normalize_stream(raw, SHIPPED_CLEANING).writeStream.format("parquet").option(
        "checkpointLocation", f"{work}/state"
    ).trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    out = spark.read.schema(
        "title string, date string, source_id string, id string, notice_key string"
    ).parquet(f"{work}/out")
    return out


@query
def q25c_stream_commit(spark, d):
    work = scratch_path(spark, "stream")
    n = _stored(spark, v.notices(spark, d))
    runs = [v.earlier_run(n), v.later_run(n)]
    columns = [c for c in ARCHIVE.names if c not in ("year", "month")]
    for run in runs:
        run.select(*columns).write.mode("append").parquet(f"{work}/in")
        arrived = spark.readStream.schema(run.select(*columns).schema).parquet(f"{work}/in")
        incremental_commit(arrived, f"{work}/lake", f"{work}/state", v.AS_OF).awaitTermination()
    return NoticeLake(spark, f"{work}/lake").manifest().select(
        "seq", "status", "current_count", "previous_count", "added", "updated", "removed"
    )
