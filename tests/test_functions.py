from datetime import date

import pytest
import regex
from fixtures import notices
from pyspark.sql import functions as F

from noticelake.config import SHIPPED_CLEANING, Breaker
from noticelake.functions import dates, ids, text, urls
from noticelake.functions.selectors import selector_supported
from noticelake.operators.snapshot import breaker_verdict
from noticelake.operators.stats import success_rate

NBSP, WIDE, NEL, ZWSP = chr(0xA0), chr(0x3000), chr(0x85), chr(0x200B)


def one(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("v")).alias("o")).collect()]


def test_white_space(spark):
    raw = [f" a{NBSP}{WIDE} b{NEL}c\n", f"{WIDE}x{ZWSP}y{NBSP}", "", None]
    assert one(spark, raw, text.normalize_ws) == ["a b c", f"x{ZWSP}y", "", None]
    assert one(spark, raw, text.strip_ws) == [f"a{NBSP}{WIDE} b{NEL}c", f"x{ZWSP}y", "", None]


def test_cleaning(spark):
    assert one(spark, [" 공지사항  첨부파일 x ", "공지"], lambda c: text.clean_title(c, SHIPPED_CLEANING)) == [
        "사항  x", ""]
    assert one(spark, ["작성일 2024. 01. 15."], lambda c: text.clean_date(c, SHIPPED_CLEANING)) == ["2024.01.15."]


@pytest.mark.parametrize("raw, normal, day", [
    ("2024.01.15", "2024-01-15", date(2024, 1, 15)),
    ("2024/1/5", "2024-01-05", date(2024, 1, 5)),
    ("2024-01-15", "2024-01-15", date(2024, 1, 15)),
    ("98.01.02", "2098-01-02", date(2098, 1, 2)),
    ("2024. 1. 5", "2024-01-05", date(2024, 1, 5)),
    ("2024.01.15.", "2024-01-15-", None),
    ("2024-02-30", "2024-02-30", None),
    ("24-1-5 x", "2024-1-5 x", None),
    ("어제", "어제", None),
    ("", "", None),
])
def test_dates(spark, raw, normal, day):
    got = spark.createDataFrame([(raw,)], "d string").select(
        dates.normalize_date(F.col("d")).alias("n"), dates.parse_date(F.col("d")).alias("p"),
        dates.archive_year(dates.normalize_date(F.col("d")), "2020-03-04").alias("y"),
        dates.archive_month(dates.normalize_date(F.col("d")), "2020-03-04").alias("m")).first()
    assert (got["n"], got["p"]) == (normal, day)
    assert (got["y"], got["m"]) == ((day.year, day.month) if day else (2020, 3))


def test_trailing_separator_option(spark):
    assert one(spark, ["2024.01.15."], lambda c: dates.normalize_date(c, True)) == ["2024-01-15"]


def test_canonical_id(spark):
    base = dict(link="https://example.com/notice/1", date="2024-01-15")
    got = notices(spark, base, {**base, "campus": " TEST "}, {**base, "title": "other"},
                  {**base, "link": "https://example.com/notice/2"}, {**base, "date": "24.1.15"}).collect()
    assert got[0]["id"].startswith("20240115-") and len(got[0]["id"]) == 15
    assert got[0]["id"] == got[1]["id"] == got[2]["id"] == got[4]["id"] != got[3]["id"]
    assert got[0]["notice_key"].startswith(got[0]["id"]) and len(got[0]["notice_key"]) == 73


def test_source_and_department_ids(spark):
    raw = ["https://e.com/view?id=123", "https://e.com/notice/456", "https://e.com/x?no=١٢", "https://e.com/x",
           "https://e.com/board/7?seq=8"]
    assert one(spark, raw, ids.extract_notice_id) == ["123", "456", "١٢", None, "8"]
    raw = ["https://EE.example.ac.kr/x", "NOT_FOUND", "https://ee.other.kr"]
    assert one(spark, raw, lambda c: ids.department_id(F.lit("Big Dept A"), c, "d", "example.ac.kr")) == [
        "d_ee", "d_big_dept_a", "d_big_dept_a"]


@pytest.mark.parametrize("base, href, expected", [
    ("https://example.com/path/", "page.html", "https://example.com/path/page.html"),
    ("https://example.com/path/", "/root.html", "https://example.com/root.html"),
    ("https://example.com/path/", "https://other.com/x", "https://other.com/x"),
    ("https://e.com/a/b?q=1#f", "", "https://e.com/a/b?q=1"),
    ("https://e.com/a/b?q=1#f", "?z=2", "https://e.com/a/b?z=2"),
    ("https://e.com/a/b?q=1", "#t", "https://e.com/a/b?q=1#t"),
    ("https://e.com/a/b/c", "../d/./e", "https://e.com/a/d/e"),
    ("https://e.com/a/b/c", "../../../..", "https://e.com/"),
    ("http://e.com", "é x", "http://e.com/%C3%A9%20x"),
    ("HTTP://E.com:80/a", "b", "http://e.com/b"),
    ("https://e.com:8080/a", "/b", "https://e.com:8080/b"),
    ("https://e.com/a", "//F.com:443/b", "https://f.com/b"),
    ("https://e.com/a", "mailto:x@y.z", "mailto:x@y.z"),
    ("https://e.com/a", "http://", "http://"),
    ("NOT_FOUND", "a", None),
])
def test_resolve_url(spark, base, href, expected):
    frame = spark.createDataFrame([(base, href)], "b string, h string")
    assert frame.select(urls.resolve_url(F.col("b"), F.col("h"))).first()[0] == expected


@pytest.mark.parametrize("base, href, expected", [
    ("http://User:pw@Host:80/x", "y", "http://User:pw@host/y"),
    ("https://u@h:443/x", "//O.com:443/z", "https://o.com/z"),
    ("https://h:80/x", "y", "https://h:80/y"),
    ("http://h:/x", "y", "http://h/y"),
    ("http://h/a/b", r"\c\d", "http://h/c/d"),
    ("http://h/a/b", r"c\d?e\f#g\h", r"http://h/a/c/d?e\f#g\h"),
    ("http://h/a/b", r"\\o.com\x", "http://o.com/x"),
    ("http://h/a/b", "///o.com/x", "http://o.com/x"),
    (r"http://h\a\b", "c", "http://h/a/c"),
    ("http://h/a/b", "?q='x'{y}`", "http://h/a/b?q=%27x%27{y}`"),
    ("http://h/a/b", "/p'{q}`", "http://h/p'%7Bq%7D%60"),
    ("http://h/a/b", "#f'{`", "http://h/a/b#f'{%60"),
    ("http://h/a/b", "http:foo", "http://h/a/foo"),
    ("http://h/a/b", "HTTP:/foo?x", "http://h/foo?x"),
    ("http://h/a/b", "https:foo/x", "https://foo/x"),
    ("http://h/a/b?k=1", "http:", "http://h/a/b?k=1"),
    ("http://h/a/b", r"mailto:a\b", r"mailto:a\b"),
])
def test_resolve_like_a_browser(spark, base, href, expected):
    frame = spark.createDataFrame([(base, href)], "b string, h string")
    assert frame.select(urls.resolve_url(F.col("b"), F.col("h"))).first()[0] == expected


def test_host(spark):
    raw = ["https://example.com/p", "https://sub.Example.com:8080/p", "http://u@a_b.e.com?q", "mailto:x@y", "x"]
    assert one(spark, raw, urls.host) == ["example.com", "sub.example.com", "a_b.e.com", None, None]


def segmented(value: str) -> list[str]:
    """Unicode word segmentation by an independent library."""
    parts = regex.split(r"(?w)\b", value.lower(), flags=regex.V1)
    words = [w for w in parts if regex.search(r"[\p{L}\p{N}]", w)]
    return [w for w in words if len(w.encode()) >= 2 and w not in text.STOPWORDS]


def test_tokens(spark, sf_dir):
    lines = ["can't 3.14 example.com a_b 가 나는 2024년 1,000 ___ the quick", "A b cd efg", "漢字 カタカナ x:y a.b.c 1.a",
             "장학금(2차) 신청·안내", "", "éa o'clock 'quoted' 12'5"]
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    values = lines + docs
    got = one(spark, values, text.tokenize)
    assert [list(g) for g in got] == [segmented(x) for x in values]


def test_college_headers(spark):
    raw = ["공과대학", "소프트웨어 융합대학", "공과대학 전기과 A", "공과 대학", "전기과", "대학", "", "공과대학전기 대학 과"]
    got = [tuple(x) for x in one(spark, raw, lambda c: text.college_header(c, "대학"))]
    assert got == [("공과대학", None), ("소프트웨어융합대학", None), ("공과대학", "전기과 A"), (None, None), (None, None),
                   (None, None), (None, None), (None, None)]
    assert one(spark, ["a 교수진 b", "a 홈페이지 교수진", " 전기과 "],
               lambda c: text.clean_header(c, ("교수진", "홈페이지"))) == ["a", "a", "전기과"]


def test_long_header_is_cheap(spark):
    # Nested repetition would take exponential time here.
    assert tuple(one(spark, ["가" * 5000 + "!"], lambda c: text.college_header(c, "대학"))[0]) == (None, None)


def test_selector_forms(spark):
    good = ["tr:has(a.c-board-title)", "td:nth-last-child(1)", "table tr:has(a)", "li.a--b:not(.c)", ".x", "a.b.c", "*",
            "div > a", "#x", "a[href]", "a,b", "td+td ~ td", "a[href^='/n?x=1']", "li:not(#x[a])", "[ a = 'b c' ]"]
    bad = ["", "tr:has(a b)", "td:hover", "> a", "a >", "a,", "a[]", "a[b=]", "a::before", "#", "a[b='c]"]
    assert one(spark, good + bad, selector_supported) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize("current, previous, status", [
    (100, 100, "safe"), (85, 100, "safe"), (80, 100, "safe"), (79, 100, "triggered"), (70, 100, "triggered"),
    (50, 0, "cold_start"), (0, 100, "empty_result"), (150, 100, "safe"), (1, 9, "cold_start"), (0, 0, "cold_start"),
    (7, 10, "triggered"),
])
def test_breaker(spark, current, previous, status):
    counts = spark.createDataFrame([(current, previous)], "current_count long, previous_count long")
    got = breaker_verdict(counts).first()
    assert got["status"] == status and got["proceed"] == (status in ("safe", "cold_start"))


def test_breaker_settings(spark):
    counts = spark.createDataFrame([(0, 0), (85, 100)], "current_count long, previous_count long")
    got = breaker_verdict(counts, Breaker(max_drop_percent=10, allow_cold_start=False)).collect()
    assert [r["status"] for r in got] == ["empty_result", "triggered"]


def test_success_rate(spark):
    frame = spark.createDataFrame([(0, 0), (233, 2)], "t long, f long")
    got = [r[0] for r in frame.select(success_rate(F.col("t"), F.col("f"))).collect()]
    assert got[0] == 0.0 and abs(got[1] - 231 / 233) < 1e-12


def test_short_ways_of_resolving(spark, monkeypatch):
    """Plain links that skip the general way get what it gives."""
    bases = ["http://d.ac.kr", "http://d.ac.kr/", "https://d.ac.kr/a/b", "http://d.ac.kr/a//b/?x=/y/", "http://d.ac.kr/a/..",
             "http://d.ac.kr/../a/b", "http://d.ac.kr:80/a/", "http://u@d.ac.kr/a/", "HTTP://D.ac.kr/a/", "http://d.ac.kr/a b/c",
             "http://d.ac.kr/a/b#/c/", "http://d.ac.kr/a\\b/c", "mailto:x", "http:///a", "", None, " http://d.ac.kr/a/ "]
    hrefs = ["sitemap", "a/b", "a//b/", "a?b=c:d", "./a", "../a", "a/../b", "a/.b", ".a", "a.", "a:b", "x?", "?x", "", None, "#", "a#b",
             "http://e.kr/", "http://e.kr", "http://e.kr/a/b?c=/d", "https://e.kr/a/../b", "http://e.kr/a//b", "http:x", "HTTP://E.kr/a",
             "http://e.kr:80/a", "http://e.kr/a b", "//e.kr/a", "http:/e.kr/a", "javascript:void(0)", "a\\b", " a ", "한글", "a?q='"]
    frame = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")

    def resolved():
        return frame.select("b", "h", urls.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()

    short = resolved()
    for name in ("_PLAIN_HREF", "_PLAIN_FAR", "_PLAIN_NEAR"):
        monkeypatch.setattr(urls, name, "(?!)")
    assert short == resolved()
