"""Hand-written pages, boards and notices."""

from __future__ import annotations

from noticelake import schemas

STANDARD = (
    '<table><tr><th>t</th></tr><tr><td>1<td><a class="x c-board-title" href="view?id=7"> 공지 '
    "<b>hello</b> &amp; you<td>2024.01.05</tr>"
    '<tr><td><a class="c-board-title">nolink</a></td><td>2024-1-6</td></tr>'
    '<tr><td><a class="c-board-title" href="#">첨부파일</a><td>x</table>'
)
NX = (
    '<div class=yon_board><table class="bl_list"><tr><td class="td-subject"><a href="/notice/5">A</a>'
    '</td><td class=td-date>24.1.2</td></tr><tr><td class="td-subject">no a</td></tr></table>'
    '<table><tr><td class="td-subject"><a href="z">B</a><td class=td-date>1</table></div>'
)
NX_ALT = (
    '<!-- x --><p>NX CMS<table class="bl_list"><tr><td class="td-subject"><a href="?id=9">C</a>'
    "<td class=td-date> 2024/03/04 </table>"
)
XE = (
    '<ul class=xe-list-board><li class="xe-list-board-list--item xe-list-board-list--header">'
    '<a class="xe-list-board-list__title-link">H</a><span class="xe-list-board-list__created_at">d</span>'
    '<li class="xe-list-board-list--item"><a class="xe-list-board-list__title-link" href="?a=1">T1</a>'
    '<span class="xe-list-board-list__created_at">2024-02-02</span></ul>'
)
PLAIN = (
    '<table><tr><td><a href="a/b">F1</a><td>2020-01-01<tr><td>none<td>2020'
    '<tr><td><a href="https://o.com/x">F2</a></table>'
)

SEED = """<html><body><h1>밖대학 밖</h1><main><h1>공과대학</h1><a href="http://x.example.ac.kr/">홈페이지</a>
<h1>전기과 교수진</h1><a href="#">홈페이지</a><a href="http://ee.example.ac.kr/">홈페이지 바로가기</a>
<a href="http://no/">홈페이지</a>
<h1>이과 융합대학 수학과</h1><p><h1>  </h1><a href="http://skip/">홈페이지</a>
<h1>물리 학과 홈페이지</h1><div><a href="http://phys.other.kr/">홈페이지</a></div>
<h1>전기과</h1><h1>물리 학과</h1><a href="http://again/">홈페이지</a></main>
<main><h1>둘째대학 과</h1></main></body></html>"""

HOME = """<body><ul><li><a href="/b/1">공지사항</a><li><a href="b/2?x=1">장학 <i>안내</i></a>
<a href="/img"><img></a><a href="/img">채용</a><a href="/b/3">공지</a><a href="/b/1">알림</a>
<a href="/long">스무 글자를 훌쩍 넘기는 아주 긴 공지 제목 링크입니다</a><a href="/view.do?seq=1">공지</a>
<a href="#">공지</a><a href="javascript:go()">공지</a><a href="mailto:a@b.c">취업 문의</a>
<a href="https://other.example.com/b">공지</a><a>공지</a>
<a href="/nosuch">SiteMap</a><a href="/map">사이트맵</a></ul>"""
SITEMAP = '<a href="/b/1">공지사항</a><a href="/b/4">학사공지</a><a href="/b/5">학부공지</a>'

NOTICE_DEFAULTS = dict(
    campus="Test", college="", department_id="dept1", department_name="Dept", board_id="notice",
    board_name="Board", title="t", author="", date="2026-02-02", link="https://example.com/1",
    source_id=None, is_pinned=False, id=None, notice_key=None,
)


def notices(spark, *rows: dict):
    """Notices from partial rows; missing ids are filled by the library's own rule."""
    from noticelake.operators.rows import identify

    full = [{**NOTICE_DEFAULTS, **r} for r in rows]
    frame = spark.createDataFrame(
        [tuple(r[n] for n in schemas.NOTICES.names) for r in full], schemas.NOTICES
    )
    if all(r["id"] is None for r in full):
        frame = identify(frame.drop("id", "notice_key")).select(*schemas.NOTICES.names)
    return frame


def keyed(spark, *pairs: tuple[str, str]):
    """Notices ``(id, title)`` whose key is the id."""
    return notices(spark, *[dict(id=i, notice_key=i, title=t) for i, t in pairs])


def numbered(spark, count: int, date: str = "2026-02-02"):
    from noticelake.operators.rows import identify
    from pyspark.sql import functions as F

    base = spark.range(count).select(
        *[
            F.concat(F.lit("https://example.com/"), F.col("id").cast("string")).alias("link")
            if n == "link"
            else F.lit(date if n == "date" else NOTICE_DEFAULTS[n])
            .cast(schemas.NOTICES[n].dataType)
            .alias(n)
            for n in schemas.NOTICES.names
            if n not in ("id", "notice_key")
        ]
    )
    return identify(base).select(*schemas.NOTICES.names)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
