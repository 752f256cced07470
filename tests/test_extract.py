import pytest
from fixtures import HOME, NX, NX_ALT, PLAIN, SEED, SITEMAP, STANDARD, XE, rows
from pyspark.sql import functions as F

from noticelake.config import SHIPPED_CLEANING, SHIPPED_PATTERNS, FALLBACK_SELECTORS, Config, Discovery
from noticelake.operators import departments as dep
from noticelake.operators import links as ln
from noticelake.operators import rows as rw
from noticelake.plans.crawl import run_crawl
from noticelake.plans.map_sites import run_map
from noticelake.schemas import BOARDS, SELECTORS
from noticelake.sources.html_nodes import extract_elements, parse_pages
from noticelake.sources.pages import classify_fetch


def pages(spark, *items):
    return spark.createDataFrame(
        [(i, u, h) for i, (u, h) in enumerate(items)], "page_id long, url string, html string"
    )


def test_tree_shape(spark):
    html = ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<div>y</p>z</div><table><tr><td>1<td>2<tr><td>3</table>"
            "<br/>t<b>u<p>v</b>w</p><script>if(a<b)</script>&lt;&amp;<![x]>e</nothing>")
    e = extract_elements(pages(spark, ("u", html)))
    got = {}
    for r in e.collect():
        got.setdefault(r["tag"], []).append((r["sib_idx"], r["sib_rev_idx"], r["text"]))
    assert got["li"] == [(1, 3, "a"), (2, 2, "bc"), (1, 1, "c"), (3, 1, "d")]
    assert got["td"] == [(1, 2, "1"), (2, 1, "2"), (1, 1, "3")]
    assert [t for *_, t in got["p"]] == ["x", "vw"]
    assert got["div"][0][2] == "yz" and got["script"][0][2] == "if(a<b)"


def test_pre_post_containment(spark, sf_dir):
    e = extract_elements(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    by_page = {}
    for r in e:
        by_page.setdefault(r["page_id"], {})[r["pre"]] = r
    for nodes in by_page.values():
        for pre, r in nodes.items():
            if r["parent"] >= 0:
                parent = nodes[r["parent"]]
                assert parent["pre"] < pre and r["last"] <= parent["last"] and r["depth"] == parent["depth"] + 1


def test_pruned_tree_gives_same_links(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = ln.extract_links(table).select("page_id", "href", "raw_text")
    whole = extract_elements(table).filter("tag = 'a' AND map_contains_key(attrs, 'href')").select(
        "page_id", F.col("attrs")["href"].alias("href"), F.col("text").alias("raw_text"))
    assert links.exceptAll(whole).isEmpty() and whole.exceptAll(links).isEmpty()


def test_large_batches_are_cut(spark):
    many = pages(spark, *[(f"u{i}", "<a href=x>t</a>" * 50) for i in range(20)]).coalesce(1)
    parsed = parse_pages(many, flush_nodes=120)
    assert rows(parsed.select("url", F.size("nodes").alias("n")), "url", "n") == sorted(
        (f"u{i}", 100) for i in range(20))


def test_segments_and_departments(spark):
    seeds = pages(spark, ("s", SEED), ("t", "<h1>공과대학 과</h1>")).withColumn("campus", F.col("url"))
    found = dep.segment_headings(dep.heading_elements(seeds), Discovery())
    assert rows(found, "page_id", "college", "department", "url") == [
        (0, "공과대학", "전기과", "http://ee.example.ac.kr/"),
        (0, "이과융합대학", "물리 학과", "http://again/"),
        (0, "이과융합대학", "물리 학과", "http://phys.other.kr/"),
        (0, "이과융합대학", "수학과", "NOT_FOUND"),
        (0, "이과융합대학", "전기과", "NOT_FOUND"),
    ]
    grouped = dep.group_departments(found.withColumn("campus", F.lit("c")), Discovery())
    assert rows(grouped, "college", "department_name", "department_id", "department_url") == [
        ("공과대학", "전기과", "dept_ee", "http://ee.example.ac.kr/"),
        ("이과융합대학", "물리 학과", "dept_물리_학과", "http://phys.other.kr/"),
        ("이과융합대학", "수학과", "dept_수학과", "NOT_FOUND"),
        ("이과융합대학", "전기과", "dept_전기과", "NOT_FOUND"),
    ]


def test_detect_cms(spark):
    got = pages(spark, ("https://h/list.do", ""), ("h", STANDARD), ("h", NX), ("h", NX_ALT), ("h", XE), ("h", PLAIN)).select(
        ln.detect_cms(F.col("url"), F.col("html"), SHIPPED_PATTERNS)["cms"]).collect()
    assert [r[0] for r in got] == ["standard", "standard", "nx", "nx_alt", "xe", None]


def boards(spark, items):
    """Boards ``(url, html, selectors or None)`` with the layout found on their own page."""
    frame = spark.createDataFrame(
        [("c", "k", f"d{i}", "D", "https://h.com/", i, f"b{i}", "B", u, h) for i, (u, h) in enumerate(items)],
        "campus string, college string, department_id string, department_name string, department_url string, "
        "board_ord long, board_id string, board_name string, board_url string, html string")
    found = ln.detect_cms(F.col("board_url"), F.col("html"), SHIPPED_PATTERNS)["selectors"]
    return frame.withColumn("s", F.coalesce(found, ln.selector_columns(FALLBACK_SELECTORS))).select("*", "s.*").drop("s")


def test_rows_of_each_layout(spark):
    b = boards(spark, [("https://h.com/list/p.do", STANDARD), ("https://h.com/list/x", NX), ("https://h.com/list/y", XE),
                       ("https://h.com/list/z", PLAIN), ("https://h.com/list/w", NX_ALT)])
    got = rw.extract_notice_rows(b, SHIPPED_CLEANING)
    assert rows(got.filter("ok"), "board_id", "row_pos", "title", "date", "link") == [
        ("b0", 0, "hello & you", "2024.01.05", "https://h.com/list/view?id=7"),
        ("b0", 1, "nolink", "2024-1-6", "https://h.com/list/p.do"),
        ("b1", 0, "A", "24.1.2", "https://h.com/notice/5"),
        ("b2", 0, "T1", "2024-02-02", "https://h.com/list/y?a=1"),
        ("b3", 0, "F1", "2020-01-01", "https://h.com/list/a/b"),
        ("b3", 1, "F2", "F2", "https://o.com/x"),
        ("b4", 0, "C", "2024/03/04", "https://h.com/list/w?id=9"),
    ]
    assert rows(rw.row_accounting(got), "department_id", "row_total", "row_failures") == [
        ("d0", 3, 1), ("d1", 2, 1), ("d2", 1, 0), ("d3", 2, 0), ("d4", 1, 0)]
    n = {r["title"]: r for r in rw.rows_to_notices(got).collect()}
    assert n["A"]["source_id"] == "5" and n["A"]["id"].startswith("20240102-") and n["C"]["source_id"] == "9"


def test_link_and_author_selectors(spark):
    html = ("<ul><li><b>T</b> <i> me </i><a data-u='/n/1' href='/x'>go</a><s>2024-01-01</s>"
            "<li><b>U</b><a href='/y'>go</a><s>2024-01-02</s><li><b>V</b><s>d</s></ul>")
    b = boards(spark, [("https://h.com/l", html)]).drop(*SELECTORS.names).select(
        "*", F.lit("ul li").alias("row_selector"), F.lit("b").alias("title_selector"), F.lit("li s:last-child").alias("date_selector"),
        F.lit("i").alias("author_selector"), F.lit(None).cast("string").alias("body_selector"),
        F.lit("data-u").alias("attr_name"), F.lit("a").alias("link_selector"))
    got = rw.extract_notice_rows(b, SHIPPED_CLEANING)
    assert rows(got, "title", "author", "link", "ok") == [
        ("T", "me", "https://h.com/n/1", True), ("U", "", "https://h.com/l", True), ("V", "", "https://h.com/l", True)]


def test_bad_selectors(spark):
    b = boards(spark, [("https://h.com/1", PLAIN), ("https://h.com/2", PLAIN), ("https://h.com/3", PLAIN)])
    b = b.withColumn("board_id", F.lit("notice")).withColumn(
        "date_selector", F.when(F.col("board_ord") == 0, "td:hover").otherwise(F.col("date_selector"))).withColumn(
        "author_selector", F.when(F.col("board_ord") == 1, "a[x=]"))
    errors = rw.selector_errors(b)
    assert rows(errors, "url", "message") == [
        ("https://h.com/1", "unsupported selector: td:hover"), ("https://h.com/2", "unsupported selector: a[x=]")]
    # Only the board itself is left out, not the others that share its id.
    result = run_crawl(b.drop("html").select(*BOARDS.names), pages(
        spark, ("https://h.com/1", PLAIN), ("https://h.com/2", PLAIN)), Config(cleaning=SHIPPED_CLEANING))
    out = result.outcome.first()
    assert (out["board_total"], out["board_failures"], out["notice_total"], out["detail_total"]) == (3, 2, 2, 2)
    assert rows(result.errors, "stage", "url") == [
        ("board_list", "https://h.com/3"), ("selector", "https://h.com/1"), ("selector", "https://h.com/2")]


@pytest.fixture(scope="module")
def mapped(spark):
    site = pages(
        spark, ("http://seed/", SEED), ("http://ee.example.ac.kr/", HOME), ("http://ee.example.ac.kr/map", SITEMAP),
        ("http://phys.other.kr/", "<p>nothing</p>"), ("http://ee.example.ac.kr/b/1", XE), ("http://ee.example.ac.kr/b/4", STANDARD))
    seeds = spark.createDataFrame([("one", "http://seed/"), ("two", "http://lost/")], "campus string, url string")
    return site, run_map(seeds, site, Config(cleaning=SHIPPED_CLEANING))


def test_boards_of_a_site(mapped):
    _, found = mapped
    assert rows(found.boards, "board_ord", "board_id", "board_name", "board_url", "title_selector") == [
        (0, "notice", "공지사항", "http://ee.example.ac.kr/b/1", "a.xe-list-board-list__title-link"),
        (1, "scholarship", "장학 안내", "http://ee.example.ac.kr/b/2?x=1", "a"),
        # The image link comes first and hides the text link to the same target ("채용").
        (4, "notice_2", "공지", "http://ee.example.ac.kr/b/3", "a"),
        (10, "career", "취업 문의", "mailto:a@b.c", "a"),
        (2**31 + 1, "academic", "학사공지", "http://ee.example.ac.kr/b/4", "a.c-board-title"),
        (2**31 + 2, "academic_2", "학부공지", "http://ee.example.ac.kr/b/5", "a"),
    ]


def test_reviews_of_a_site(mapped):
    _, found = mapped
    assert rows(found.reviews, "campus", "name", "reason") == [
        ("one", "물리 학과", "No boards discovered from homepage or sitemap"),
        ("one", "수학과", "Homepage URL is invalid"),
        ("one", "전기과", "Homepage URL is invalid"),
        ("two", "two", "Failed to fetch seed page"),
    ]


def test_crawl_of_a_site(mapped):
    site, found = mapped
    result = run_crawl(found.boards.select(*BOARDS.names), site, Config(cleaning=SHIPPED_CLEANING))
    assert rows(result.notices, "board_id", "title", "college") == [
        ("academic", "hello & you", "공과대학"), ("academic", "nolink", "공과대학"), ("notice", "T1", "공과대학")]
    out = result.outcome.first().asDict()
    assert out == {"board_total": 6, "board_failures": 4, "notice_total": 4, "notice_failures": 1,
                   "detail_total": 3, "detail_failures": 0}


def test_fetch_rules(spark):
    log = spark.createDataFrame(
        [("a", 200, "text/html; charset=x", 5, None), ("b", 200, "application/pdf", 5, None), ("c", 200, None, None, None),
         ("d", 200, "text/html", 2_000_000, None), ("e", 200, "text/html", 2_000_001, None), ("f", 304, "application/pdf", 1, None),
         ("g", 404, None, 1, None), ("h", 429, None, 1, None), ("i", 503, None, 1, None), ("j", None, None, None, "timeout"),
         ("k", None, None, None, "decode"), ("l", 200, "application/xhtml+xml", 1, None)],
        "k string, status int, content_type string, content_length long, transport_error string")
    assert rows(classify_fetch(log), "k", "outcome", "retryable") == [
        ("a", "ok", False), ("b", "unexpected_content_type", False), ("c", "ok", False), ("d", "ok", False),
        ("e", "body_too_large", False), ("f", "not_modified", False), ("g", "upstream_http", False),
        ("h", "upstream_http", True), ("i", "upstream_http", True), ("j", "transport", True), ("k", "transport", False),
        ("l", "ok", False)]


def test_found_pages_are_dealt(spark, tmp_path):
    """Pages of one kind that are stored side by side are parsed by many tasks."""
    from noticelake.operators.dedupe import with_html
    from noticelake.session import deals

    n = 400
    rows = [(i, f"http://d{i}.ac.kr/", f"<a href=/b{i}>b</a>") for i in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    owners = spark.createDataFrame([(u, i) for i, u, _ in rows], "home string, owner long")
    for bound in (200_000, 10):
        found = with_html(owners, pages, "home", max_rows=bound)
        assert found.columns == ["html", "home", "owner"]
        assert {(r.owner, r.html) for r in found.collect()} == {(i, h) for i, _, h in rows}
        counts = [len(x) for x in found.rdd.glom().collect()]
        assert len(counts) == deals(spark) and max(counts) < n / 4


def test_a_crawl_looks_for_its_pages_once(spark, monkeypatch):
    """Boards with and without a page come from one search for the last fetches; no board is lost or doubled."""
    from noticelake.operators import dedupe
    from noticelake.plans import crawl
    from noticelake.plans.crawl import attach_pages

    searches, search = [], dedupe.latest_pages
    monkeypatch.setattr(dedupe, "latest_pages", lambda *given: searches.append(1) or search(*given))
    pages = spark.createDataFrame(
        [(1, "u1", "old"), (3, "u1", "new"), (2, "u2", None), (4, None, "x"), (5, "u9", "y")],
        "page_id long, url string, html string")
    boards = spark.createDataFrame(
        [("a", "u1"), ("b", "u1"), ("c", "u2"), ("d", "u3"), ("d", "u3"), ("e", None)], "board_id string, board_url string")
    got = sorted((tuple(r) for r in attach_pages(boards, pages).select("board_id", "html", "page_found").collect()), key=str)
    assert got == [("a", "new", True), ("b", "new", True), ("c", None, True), ("d", None, False), ("d", None, False),
                   ("e", None, False)]
    assert len(searches) == 1 and not hasattr(crawl, "without_page")


def test_unwanted_links_keep_their_positions(spark):
    html = "<a href='#'>x</a><a>no</a><a href=/b>y<b>z</b></a><a href>e</a>"
    page = spark.createDataFrame([(1, "http://a.kr/", html)], "page_id long, url string, html string")
    every = [tuple(r) for r in ln.extract_links(page).select("pos", "raw_text", "href", "link_url").collect()]
    assert every == [(0, "x", "#", "http://a.kr/#"), (1, "yz", "/b", "http://a.kr/b"), (2, "e", "", "http://a.kr/")]
    some = ln.extract_links(page, wanted=F.col("href") != "#").select("pos", "raw_text", "href", "link_url")
    assert [tuple(r) for r in some.collect()] == every[1:]
