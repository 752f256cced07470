"""Links of pages: extraction, board-link rules, keyword match, numbering, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.config import CmsPattern, Discovery, Keyword, Selectors
from noticelake.functions.patterns import MANY, chosen, first_contained
from noticelake.functions.urls import PLAIN_ROOT, host, resolve_url
from noticelake.operators.dedupe import _small, first_per_key, latest_fetch
from noticelake.functions.text import strip_ws
from noticelake.sources.html_nodes import LINK, page_links, rows_of_pages


def extract_links(
    pages: DataFrame, base: str = "url", html: str = "html", wanted: Column | None = None
) -> DataFrame:
    """All ``a[href]`` of each page in document order: ``pos, text, href, link_url``.

    ``wanted``, over ``raw_text``, ``text`` and ``href``, says which links a job needs: the others
    keep their positions but are not resolved.
    """
    links = rows_of_pages(pages, page_links, LINK, html).withColumn("text", strip_ws(F.col("raw_text")))
    if wanted is not None:
        links = links.filter(wanted)
    return links.withColumn("link_url", resolve_url(F.col(base), F.col("href")))


def href_not_blacklisted(href: Column, blacklist: Sequence[str]) -> Column:
    keep = F.lit(True)
    for part in blacklist:
        keep = keep & ~href.contains(part)
    return keep


def link_text_max_len(text: Column, limit: int) -> Column:
    return F.char_length(text) <= limit


def navigable_href(href: Column) -> Column:
    return ~href.contains("javascript") & (href != "#")


def same_host(base_url: Column, link_url: Column) -> Column:
    """False only where both hosts are known and differ."""
    # The usual case: the link begins with the plain origin of the page.
    origin = F.nullif(F.regexp_extract(base_url, PLAIN_ROOT, 0), F.lit(""))
    return F.coalesce(F.startswith(link_url, origin), F.lit(False)) | ~F.coalesce(
        host(base_url) != host(link_url), F.lit(False))


def board_like(rules: Discovery) -> Column:
    """The board-link rules that need no target: href and text alone."""
    return (
        href_not_blacklisted(F.col("href"), rules.blacklist)
        & link_text_max_len(F.col("text"), rules.max_link_text)
        & navigable_href(F.col("href"))
    )


def board_links(links: DataFrame, rules: Discovery, base: str = "url") -> DataFrame:
    """Links that may lead to a board."""
    return links.filter(
        board_like(rules)
        & F.col("link_url").isNotNull()
        & same_host(F.col(base), F.col("link_url"))
    )


def dedupe_links(links: DataFrame, page_key: Sequence[str]) -> DataFrame:
    """First link per target within a page, before any keyword is looked at."""
    return first_per_key(links, [*page_key, "link_url"], ["pos"])


def match_keyword(text: Column, keywords: Sequence[Keyword]) -> Column:
    """``struct(board_id, display_name)`` of the first keyword the text contains, else NULL."""
    if len(keywords) > MANY:
        index = first_contained([text], [[k.keyword for k in keywords]])
        return chosen(index, ["board_id", "display_name"], [(k.board_id, k.display_name) for k in keywords])
    return F.coalesce(
        *[
            F.when(
                text.contains(k.keyword),
                F.struct(
                    F.lit(k.board_id).alias("board_id"),
                    F.lit(k.display_name).alias("display_name"),
                ),
            )
            for k in keywords
        ]
    )


def number_duplicate_ids(boards: DataFrame, page_key: Sequence[str]) -> DataFrame:
    """The n-th board with the same id on a page becomes ``id_n`` from n = 2 on.

    A group is at most one page's links, so the page size bounds it.
    """
    nth = F.row_number().over(Window.partitionBy(*page_key, "board_id").orderBy("pos"))
    return (
        boards.withColumn("_n", nth)
        .withColumn(
            "board_id",
            F.when(F.col("_n") > 1, F.concat_ws("_", "board_id", F.col("_n").cast("string")))
            .otherwise(F.col("board_id")),
        )
        .drop("_n")
    )


def keyword_boards(links: DataFrame, rules: Discovery, page_key: Sequence[str]) -> DataFrame:
    """Deduplicated board links to boards: keyword match, name, id numbering."""
    matched = (
        dedupe_links(links, page_key)
        .withColumn("_board", match_keyword(F.col("text"), rules.keywords))
        .filter("_board IS NOT NULL")
    )
    named = matched.select(
        *[c for c in matched.columns if c not in ("_board", "raw_text", "href", "text", "link_url")],
        F.col("_board.board_id").alias("board_id"),
        F.when(F.col("text") == "", F.col("_board.display_name"))
        .otherwise(F.col("text"))
        .alias("board_name"),
        F.col("link_url").alias("board_url"),
    )
    return number_duplicate_ids(named, page_key)


def merge_boards(boards: DataFrame, key: Sequence[str]) -> DataFrame:
    """One board per URL; ``source_prio`` then position decides which stays."""
    return first_per_key(boards, [*key, "board_url"], ["source_prio", "pos"])


def sitemap_candidates(links: DataFrame, pattern: str) -> DataFrame:
    """Links whose text names a sitemap."""
    return links.filter(F.col("raw_text").rlike(pattern) & F.col("link_url").isNotNull())


def find_sitemap_page(
    links: DataFrame, page_urls: DataFrame, key: Sequence[str], pattern: str
) -> DataFrame:
    """Per key, the first sitemap link whose page exists: ``key..., sitemap_url``."""
    available = sitemap_candidates(links, pattern).join(
        page_urls.select(F.col("url").alias("link_url")), "link_url", "left_semi"
    )
    return available.groupBy(*key).agg(F.min_by("link_url", "pos").alias("sitemap_url"))


def selector_columns(s: Selectors) -> Column:
    """Selector set as a struct with the field names of the boards table."""
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in _selector_values(s).items()])


def _selector_values(s: Selectors) -> dict[str, str | None]:
    return {
        "row_selector": s.row,
        "title_selector": s.title,
        "date_selector": s.date,
        "author_selector": s.author,
        "body_selector": s.body,
        "attr_name": s.attr_name,
        "link_selector": s.link,
    }


def _named_parts(patterns: Sequence[CmsPattern]) -> list[list[str | None]]:
    """URL parts and html parts of the patterns; html is searched in lower case."""
    return [[p.url_contains for p in patterns],
            [p.html_contains if p.html_contains is None else p.html_contains.lower() for p in patterns]]


def _hits(url: Column, html: Column, patterns: Sequence[CmsPattern]) -> list[Column]:
    lowered, hits = F.lower(html), []
    for url_part, html_part in zip(*_named_parts(patterns), strict=True):
        hit = F.lit(False)
        if url_part is not None:
            hit = hit | url.contains(url_part)
        if html_part is not None:
            hit = hit | lowered.contains(html_part)
        hits.append(hit)
    return hits


def _layout(p: CmsPattern) -> Column:
    return F.struct(F.lit(p.name).alias("cms"), selector_columns(p.selectors).alias("selectors"))


def _long_list_layout(index: Column, patterns: Sequence[CmsPattern]) -> Column:
    names = list(_selector_values(patterns[0].selectors))
    found = chosen(index, ["cms", *names], [(p.name, *_selector_values(p.selectors).values()) for p in patterns])
    layout = F.struct(found["cms"].alias("cms"), F.struct(*[found[n].alias(n) for n in names]).alias("selectors"))
    return F.when(index.isNotNull(), layout)


def detect_cms(url: Column, html: Column, patterns: Sequence[CmsPattern]) -> Column:
    """``struct(cms, selectors)`` of the first pattern whose URL part or html part is found.

    The URL part is case-sensitive, the html part is not. The list is configuration, so it is
    a chain of conditions and needs no join; a long list is an automaton.
    """
    if len(patterns) > MANY:
        return _long_list_layout(first_contained([url, F.lower(html)], _named_parts(patterns)), patterns)
    return F.coalesce(*[F.when(hit, _layout(p)) for hit, p in zip(_hits(url, html, patterns), patterns, strict=True)])


def cms_number(url: Column, html: Column, patterns: Sequence[CmsPattern]) -> Column:
    """The place in ``patterns`` of the one that ``detect_cms`` finds: four bytes where its selectors are a row of texts."""
    if len(patterns) > MANY:
        return first_contained([url, F.lower(html)], _named_parts(patterns))
    return F.coalesce(*[F.when(hit, F.lit(i)) for i, hit in enumerate(_hits(url, html, patterns))])


def cms_of_number(number: Column, patterns: Sequence[CmsPattern]) -> Column:
    """What ``detect_cms`` gives, from a ``cms_number``."""
    if len(patterns) > MANY:
        return _long_list_layout(number, patterns)
    return F.coalesce(*[F.when(number == i, _layout(p)) for i, p in enumerate(patterns)])


def resolve_selectors(boards: DataFrame, pages: DataFrame, rules: Discovery, max_rows: int = 200_000) -> DataFrame:
    """Selectors per board: homepage layout (``detected``, its selectors or its ``cms_number``), own page's layout, fallback.

    ``boards`` are stored. Only the last fetch of a board's page decides. Few boards travel to the pages, and only
    their pages are looked into; of more, detection runs inside the scan of the pages: URLs and numbers of
    layouts are shuffled, never html.
    """
    read = pages.withColumnRenamed("url", "board_url")
    if _small(boards, max_rows):
        read = read.join(F.broadcast(boards.select("board_url").distinct()), "board_url", "left_semi")
    own = read.select("board_url", latest_fetch(pages).alias("_fetch"),
                      cms_number(F.col("board_url"), F.col("html"), rules.patterns).alias("_number"))
    # A struct around the number: the last fetch decides even if no pattern knows it.
    own = own.groupBy("board_url").agg(F.max_by(F.struct("_number"), "_fetch").alias("_own"))
    detected = F.col("detected")
    if isinstance(boards.schema["detected"].dataType, T.IntegerType):
        detected = cms_of_number(detected, rules.patterns)["selectors"]
    own_layout = cms_of_number(F.col("_own._number"), rules.patterns)["selectors"]
    chosen = F.coalesce(detected, own_layout, selector_columns(rules.fallback))
    joined = boards.join(own, "board_url", "left").withColumn("_chosen", chosen)
    return joined.select(*[c for c in boards.columns if c != "detected"], "_chosen.*")
