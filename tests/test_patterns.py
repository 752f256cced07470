"""Thousands of patterns against the chain of conditions that a short list is."""

from pyspark.sql import functions as F

from noticelake.config import CmsPattern, Keyword, Selectors
from noticelake.operators import links as ln


def test_5000_patterns_equal_conditions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "", ""), (-3, None, "x LANG=\"FR\"")],
                              "page_id long, url string, html string"))
    real = [
        CmsPattern("paged", Selectors("ul li", "a", "a"), url_contains="page="),
        CmsPattern("french", Selectors("nav li", "a", "a"), url_contains="/fr/", html_contains='LANG="FR"'),
        CmsPattern("again", Selectors("p", "a", "a"), url_contains="page="),
        CmsPattern("any", Selectors("table tr", "a", "a"), url_contains="http"),
    ]
    absent = [CmsPattern(f"absent{i}", Selectors(f"ul.c{i}", "a", "a"), html_contains=f"no such text {i}")
              for i in range(4_996)]
    few = ln.detect_cms(F.col("url"), F.col("html"), real)
    many = ln.detect_cms(F.col("url"), F.col("html"), [*absent[:2_500], *real, *absent[2_500:]])
    rows = pages.select("page_id", few.alias("few"), many.alias("many")).collect()
    assert all(r.few == r.many for r in rows)
    assert {r.few.cms if r.few else None for r in rows} > {"french", "any"}


def test_5000_keywords(spark):
    texts = ["", None, "board 17", "notice", "a notice of board 4999 and board 17", "nothing", "\uacf5\uc9c0 9"]
    keywords = [Keyword(f"board {i}", f"b{i}", f"Board {i}") for i in range(4_998, -1, -1)]
    keywords += [Keyword("notice", "n", "Notices"), Keyword("\uacf5\uc9c0", "k", "K")]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.hit and tuple(r.hit) for r in frame.select("text", ln.match_keyword(F.col("text"), keywords).alias("hit")).collect()}
    for t in texts:
        hit = next(((k.board_id, k.display_name) for k in keywords if t is not None and k.keyword in t), None)
        assert got[t] == hit


def test_an_empty_pattern_fits_every_text(spark):
    keywords = [Keyword(f"x{i}", f"b{i}", "") for i in range(80)] + [Keyword("", "all", "All")]
    frame = spark.createDataFrame([("x7",), ("",), (None,)], "text string")
    got = [r.hit and r.hit.board_id for r in frame.select(ln.match_keyword(F.col("text"), keywords).alias("hit")).collect()]
    assert sorted(map(str, got)) == ["None", "all", "b7"]
