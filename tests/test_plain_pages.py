"""Plain markup is cut up by one pattern; it must give the tree that the standard library's scanner gives."""

import random

import pytest
from fixtures import HOME, NX, NX_ALT, PLAIN, SEED, STANDARD, XE

from noticelake.sources.html_nodes import _Tree, page_links

PIECES = [
    '<a href="/x?a=1&b=2">', "<a href='x'>", "<a href=x>", "<a href=x/>", "<br/>", "<br />", "<input disabled/>", "<p>",
    "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "text", "공지 &amp; x", "&#1;", "&lt", "&notit;", " ", "\n",
    "<!-- x -->", "<!-->", "<!--->", "<!-- a -- b -->", "<!DOCTYPE html>", "<!doctype>", "<script>", "var a='<b>';",
    "</script>", "<SCRIPT type=x>if(a<b){}</Script>", "<style>a{}</style>", "<style/>", "<title>", "</title>",
    "<title>t &amp; x</title>", "<textarea>q</textarea>", "<script>x</style>", '<a b="1"c="2">', "<a b = 'x'>", "<a b=>",
    '<a b="">', "<a b='&copy=1&lt;'>", "<A HREF=\"Q\" Class='z y'>", "<a\x0bb=c>", "<a b=\xa0c>", "< a", "<3", "<", "</",
    "</ a>", "</a b>", "</>", "<?php ?>", "<![CDATA[x]]>", "&", '<a b="x>y">', "<a b='<'>", "<li>", "<ul>", "</ul>",
    "<h1>", "</h1>", "<a b", "<iframe>", "<noscript>", "<svg>", "<a-b c>", "<a 1=2>", "<a b=c=d>", "<a x y z=1 x=\"2\">",
    "<plaintext>", "</P\n>", "-->", "\x00", "<scripty>", '"', "'",
]


class Scanned(_Tree):
    def _plain(self, html):
        return False


def tree(kind, html):
    made = kind()
    return made.finish(html), made.children


def test_the_same_tree_either_way():
    seed = random.Random(5)
    for n in range(20_000):
        pool = PIECES if n % 3 else list("<>/!-=\"'& ab\nscrip")
        html = "".join(seed.choices(pool, k=seed.randrange(1, 12)))
        assert tree(_Tree, html) == tree(Scanned, html), html


@pytest.mark.parametrize("html", [STANDARD, NX, NX_ALT, XE, PLAIN, SEED, HOME])
def test_plain_pages_need_no_scanner(monkeypatch, html):
    want = tree(Scanned, html), page_links(html)
    monkeypatch.setattr(_Tree, "feed", None)
    assert (tree(_Tree, html), page_links(html)) == want
