"""Pages to element trees: one Arrow pass over the html, everything after it is native.

A page becomes one ``array<struct>`` in document order. The array position of a node is its
``pre`` number and ``last`` is the position of its last descendant, so the descendants of a
node are one ``slice``: no join, no shuffle, and work linear in the page.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.session import bound_batches

# The parse function carries this module along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = "#text"

NODE = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sib", T.IntegerType()),
        T.StructField("rsib", T.IntegerType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)

# Fixed values of HTML: elements without content, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"td", "th", "tr"},
    "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "thead": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tfoot": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "a": {"a"},
}
# An implied end looks no further up than these.
SCOPE = {
    "li": {"ul", "ol", "table", "td", "th"},
    "dt": {"dl", "table", "td", "th"},
    "dd": {"dl", "table", "td", "th"},
    "a": {"table", "td", "th"},
}
P, ONLY_TABLE = frozenset({"p"}), frozenset({"table"})
INLINE = frozenset("a b big code em font i s small span strike strong tt u".split())
CELL = frozenset({"td", "th", "caption"})
TABLE = frozenset({"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"})
# What a start tag has to look after: whether it ends a paragraph, what else it ends and how far up, whether it stays
# open. Tags that are not here open an element and nothing else.
RULES = {
    tag: (tag in ENDS_P, ENDED_BY.get(tag, frozenset()), SCOPE.get(tag, ONLY_TABLE), tag not in VOID)
    for tag in {*ENDS_P, *ENDED_BY, *VOID}
}


# Plain markup: tokens that the standard library's scanner reads in one way only, so that a page made of
# nothing else is cut up by one pattern. Any other page goes through the scanner.
_SP = r"[ \t\n\r\f]"
_NAME = r"[A-Za-z][A-Za-z0-9]*+"
_ATTRIBUTE = (rf"{_SP}++([A-Za-z][A-Za-z0-9_:.-]*+)"
              rf"(=(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\r\f\v\"'<>`=/&\x1c-\x1f\x80-\uffff]++)(?=[ \t\n\r\f>]|\Z)))?")
_RUN = rf"(?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)}(?=[ \t\n\r\f/>]))*+"
# Elements whose content is text, whole or not at all.
_RAW, _ESCAPABLE = "(?i:script|style)", "(?i:title|textarea)"
_OTHER_RAW = "(?i:xmp|iframe|noembed|noframes|plaintext)"
_TOKEN = (
    r"([^<]++)"
    rf"|</({_NAME}){_SP}*+>"
    rf"|<(?!(?:{_RAW}|{_ESCAPABLE}|{_OTHER_RAW})[ \t\n\r\f/>])({_NAME})({_RUN}){_SP}*+/?>"
    rf"|<({_RAW})({_RUN}){_SP}*+>((?:[^<]|<(?![/!]))*+)</({_RAW}){_SP}*+>"
    rf"|<({_ESCAPABLE})({_RUN}){_SP}*+>([^<]*+)</({_ESCAPABLE}){_SP}*+>"
    r"|<!--(?!-?>)(?:[^-]|-(?!-))*+-->"
    r"|<!(?i:doctype)[ \t\n\r\f][^<>\[\]]*+>"
)
# From the first other token on, the rest of the page is one token: a page is read once to cut and to judge it.
PLAIN_TOKEN, PLAIN_ATTRIBUTE = re.compile(rf"{_TOKEN}|((?s:.++))"), re.compile(_ATTRIBUTE)


class _Value(HTMLParser):
    """The value of an attribute as the scanner reads it."""

    def handle_starttag(self, tag, attrs):
        self.value = attrs[0][1]


def _unescaped_value(value: str) -> str:
    mark, reader = "'" if '"' in value else '"', _Value()
    reader.feed(f"<a x={mark}{value}{mark}>")
    return reader.value


@lru_cache(maxsize=4096)
def _attributes(run: str) -> list[tuple[str, str | None]]:
    """The attributes of a start tag; pages of one site write the same ones again and again, so trees share the list."""
    found = []
    for name, given, double, single, bare in PLAIN_ATTRIBUTE.findall(run):
        value = double or single or bare
        found.append((name.lower(), (_unescaped_value(value) if "&" in value else value) if given else None))
    return found


class _Tree(HTMLParser):
    """Open-element stack over the tokens of a page: plain markup by one pattern, other markup by the
    standard library's tag scanner."""

    def __init__(self) -> None:  # the scanner itself is made ready where a page needs it
        self.nodes: list[list] = []  # tag, last, parent, depth, sib, attrs, text
        self.open: list[int] = []
        self.around: list[str] = []  # the tags of the open elements
        self.children: dict[int, int] = {}

    def _pop_to(self, depth: int) -> None:
        last = len(self.nodes) - 1
        for pre in self.open[depth:]:
            self.nodes[pre][1] = last
        del self.open[depth:], self.around[depth:]

    def _end_nearest(self, tags, stops) -> None:
        """End the outermost open element of ``tags`` below the nearest of ``stops``."""
        cut, depth = None, len(self.open)
        for pre in reversed(self.open):
            depth -= 1
            tag = self.nodes[pre][0]
            if tag in stops:
                break
            if tag in tags:
                cut = depth
        if cut is not None:
            self._pop_to(cut)

    def handle_starttag(self, tag, attrs):
        rule, opened, around, nodes = RULES.get(tag), self.open, self.around, self.nodes
        if rule is not None:
            if rule[0] and "p" in around:
                self._end_nearest(P, TABLE)
            if rule[1] and not rule[1].isdisjoint(around):
                self._end_nearest(rule[1], rule[2])
        pre, parent = len(nodes), opened[-1] if opened else -1
        sib = self.children[parent] = self.children.get(parent, 0) + 1
        nodes.append([tag, pre, parent, len(opened), sib, attrs, None])
        if rule is None or rule[3]:
            opened.append(pre)
            around.append(tag)

    def handle_startendtag(self, tag, attrs):
        # "<div/>" opens a div in HTML; only void elements end themselves.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.around and self.around[-1] == tag:
            self.around.pop()
            self.nodes[self.open.pop()][1] = len(self.nodes) - 1
            return
        for depth in range(len(self.open) - 1, -1, -1):
            open_tag = self.nodes[self.open[depth]][0]
            if open_tag == tag:
                self._pop_to(depth)
                return
            if tag in INLINE and open_tag not in INLINE:
                return
            if open_tag == "table" or (open_tag in CELL and tag not in TABLE):
                return

    def parse_marked_section(self, i, report=1):
        # "<![...]" of unknown kind is a comment to a browser, not a fault.
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        opened = self.open
        self.nodes.append([TEXT, len(self.nodes), opened[-1] if opened else -1, len(opened), 0, None, data])

    def _plain(self, html: str) -> bool:
        """Build the tree of a page of plain markup; of another one nothing."""
        tokens = PLAIN_TOKEN.findall(html)
        if tokens and tokens[-1][12]:
            return False
        if any([t[4].lower() != t[7].lower() or t[8].lower() != t[11].lower() for t in tokens if t[4] or t[8]]):
            return False
        nodes, opened, around, start = self.nodes, self.open, self.around, self.handle_starttag
        for text, end, tag, run, raw, raw_run, code, _, soft, soft_run, words, _, _ in tokens:
            if text:
                nodes.append([TEXT, len(nodes), opened[-1] if opened else -1, len(opened), 0, None,
                              unescape(text) if "&" in text else text])
            elif tag:
                start(tag.lower(), _attributes(run) if run else [])
            elif end and around and around[-1] == end:
                around.pop()
                nodes[opened.pop()][1] = len(nodes) - 1
            elif end:
                self.handle_endtag(end.lower())
            elif raw or soft:
                start((raw or soft).lower(), _attributes(raw_run or soft_run))
                if code or words:
                    self.handle_data(code or unescape(words))
                self.handle_endtag((raw or soft).lower())
        return True

    def finish(self, html: str) -> list[list]:
        if not self._plain(html):
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
        self._pop_to(0)
        return self.nodes


def _kept(nodes: list[list], tags: frozenset[str] | None) -> list[int]:
    """Positions of the wanted elements and of the text inside them."""
    if tags is None:
        return list(range(len(nodes)))
    kept, until = [], -1
    for pre, node in enumerate(nodes):
        if node[0] in tags:
            until = max(until, node[1])
            kept.append(pre)
        elif node[0] == TEXT and pre <= until:
            kept.append(pre)
    return kept


class _NodeColumn:
    """Grows the flat child columns of one ``array<node>`` column."""

    def __init__(self) -> None:
        self.page_ends = [0]
        self.fields: dict[str, list] = {f.name: [] for f in NODE if f.name not in ("classes", "attrs")}
        self.classes: list[str] = []
        self.class_ends = [0]
        self.keys: list[str] = []
        self.values: list[str] = []
        self.attr_ends = [0]

    def __len__(self) -> int:
        return len(self.fields["pre"])

    def add(self, html: str | None, tags: frozenset[str] | None) -> None:
        tree = _Tree()
        nodes = tree.finish(html or "")
        kept = _kept(nodes, tags)
        # rank[i]: how many kept nodes come before position i
        rank, seen = [0] * (len(nodes) + 1), 0
        wanted = bytearray(len(nodes))
        for pre in kept:
            wanted[pre] = 1
        for pre in range(len(nodes)):
            rank[pre] = seen
            seen += wanted[pre]
        rank[len(nodes)] = seen
        cols = self.fields
        for pre in kept:
            tag, last, parent, depth, sib, attrs, text = nodes[pre]
            rsib = tree.children.get(parent, 0) - sib + 1 if sib else 0
            while parent >= 0 and not wanted[parent]:
                parent = nodes[parent][2]
            cols["tag"].append(tag)
            cols["pre"].append(rank[pre])
            cols["last"].append(rank[last + 1] - 1)
            cols["parent"].append(rank[parent] if parent >= 0 else -1)
            cols["depth"].append(depth)
            cols["sib"].append(sib)
            cols["rsib"].append(rsib)
            cols["text"].append(text)
            names = dict(reversed([(k, v or "") for k, v in attrs])) if attrs else {}
            self.classes.extend(names.get("class", "").split())
            self.class_ends.append(len(self.classes))
            self.keys.extend(names.keys())
            self.values.extend(names.values())
            self.attr_ends.append(len(self.keys))
        self.page_ends.append(len(self))

    def build(self) -> pa.Array:
        i32 = pa.int32()
        arrays = {
            name: pa.array(vals, pa.string() if name in ("tag", "text") else i32)
            for name, vals in self.fields.items()
        }
        arrays["classes"] = pa.ListArray.from_arrays(
            pa.array(self.class_ends, i32), pa.array(self.classes, pa.string())
        )
        arrays["attrs"] = pa.MapArray.from_arrays(
            pa.array(self.attr_ends, i32),
            pa.array(self.keys, pa.string()),
            pa.array(self.values, pa.string()),
        )
        struct = pa.StructArray.from_arrays([arrays[n] for n in NODE.names], NODE.names)
        return pa.ListArray.from_arrays(pa.array(self.page_ends, i32), struct)


def parse_pages(
    pages: DataFrame,
    html: str = "html",
    tags: tuple[str, ...] | None = None,
    flush_nodes: int = 200_000,
    flush_chars: int = 16_000_000,
) -> DataFrame:
    """Replace the html column by ``nodes``; all other columns pass through.

    ``tags`` keeps only those elements and the text inside them: a job that needs links does
    not carry the rest of the tree out of Python. Output batches are cut by nodes and html
    length, so memory follows the page size and not the batch size.
    """
    wanted = frozenset(tags) if tags is not None else None
    rest = [f for f in pages.schema if f.name != html]
    schema = T.StructType(rest + [T.StructField("nodes", T.ArrayType(NODE))])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(html))
            start, chars, nodes = 0, 0, _NodeColumn()
            for i in range(batch.num_rows):
                page = source[i].as_py()
                nodes.add(page, wanted)
                chars += len(page or "")
                full = len(nodes) >= flush_nodes or chars >= flush_chars
                if full or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    columns = [part.column(part.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays(columns + [nodes.build()], names + ["nodes"])
                    start, chars, nodes = i + 1, 0, _NodeColumn()

    bound_batches(pages.sparkSession)
    return pages.mapInArrow(run, schema)


#: Rows of one output batch of ``rows_of_pages``, at most one page beyond.
FLUSH_ROWS = 20_000

LINK = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("raw_text", T.StringType()),
    T.StructField("href", T.StringType())])
HEADING = T.StructType([
    T.StructField("pre", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _inner_text(nodes: list[list], pre: int) -> str:
    return "".join([n[6] for n in nodes[pre + 1: nodes[pre][1] + 1] if n[0] == TEXT])


def _attribute(attrs: list, name: str) -> str | None:
    """The first attribute of that name; one without a value is empty."""
    for key, value in attrs or ():
        if key == name:
            return value or ""
    return None


def page_links(html: str | None) -> list[tuple]:
    """(pos, raw_text, href) of each ``a[href]`` in document order."""
    nodes = _Tree().finish(html or "")
    hrefs = [(pre, _attribute(n[5], "href")) for pre, n in enumerate(nodes) if n[0] == "a"]
    found = [(pre, href) for pre, href in hrefs if href is not None]
    return [(i, _inner_text(nodes, pre), href) for i, (pre, href) in enumerate(found)]


def page_headings(html: str | None) -> list[tuple]:
    """(pre, tag, text, href) of ``h1`` and ``a`` in the first ``main``; ``pre`` counts the nodes of
    ``main``, ``h1`` and ``a`` and the texts inside these."""
    nodes = _Tree().finish(html or "")
    kept = _kept(nodes, frozenset(("main", "h1", "a")))
    main = next((pre for pre in kept if nodes[pre][0] == "main"), None)
    if main is None:
        return []
    last = nodes[main][1]
    return [(rank, nodes[pre][0], _inner_text(nodes, pre), _attribute(nodes[pre][5], "href"))
            for rank, pre in enumerate(kept) if main < pre <= last and nodes[pre][0] in ("h1", "a")]


def rows_of_pages(
    pages: DataFrame, pick: Callable[[str | None], list[tuple]], found: T.StructType, html: str = "html"
) -> DataFrame:
    """One row per tuple that ``pick`` makes of a page, in place of the html.

    What a job does not ask for never leaves Python, and memory is that of one page at a time. A page's tuples
    leave as one list, so its other columns are not copied for each; outside they become rows.
    """
    rest = [f for f in pages.schema if f.name != html]
    names = [f.name for f in rest]
    kinds = [_ARROW[f.dataType.simpleString()] for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, ends, rows = 0, [0], []
            texts = batch.column(batch.schema.get_field_index(html))
            for i in range(batch.num_rows):
                rows.extend(pick(texts[i].as_py()))
                ends.append(len(rows))
                if len(rows) >= FLUSH_ROWS or i == batch.num_rows - 1:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds),
                                                           kinds, strict=True)]
                    lists = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, found.names))
                    part = batch.slice(start, i + 1 - start)
                    kept = [part.column(part.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays([*kept, lists], [*names, "_found"])
                    start, ends, rows = i + 1, [0], []

    bound_batches(pages.sparkSession)
    listed = pages.mapInArrow(run, T.StructType([*rest, T.StructField("_found", T.ArrayType(found))]))
    return listed.select(*names, F.inline("_found"))


def descendants(nodes: Column, node: Column) -> Column:
    """Nodes inside ``node``, in document order."""
    return F.slice(nodes, node["pre"] + 2, node["last"] - node["pre"])


def node_text(nodes: Column, node: Column) -> Column:
    """All text inside ``node``, joined in document order."""
    inside = F.filter(descendants(nodes, node), lambda n: n["tag"] == TEXT)
    return F.array_join(F.transform(inside, lambda n: n["text"]), "")


def extract_elements(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element, with its position numbers, attributes and text."""
    parsed = parse_pages(pages.select(key, "html"))
    elements = F.transform(
        F.filter(F.col("nodes"), lambda n: n["tag"] != TEXT),
        lambda n: F.struct(
            n["pre"].alias("pre"),
            n["last"].alias("last"),
            n["parent"].alias("parent"),
            n["depth"].alias("depth"),
            n["tag"].alias("tag"),
            n["classes"].alias("classes"),
            n["attrs"].alias("attrs"),
            n["sib"].alias("sib_idx"),
            n["rsib"].alias("sib_rev_idx"),
            node_text(F.col("nodes"), n).alias("text"),
        ),
    )
    return parsed.select(key, F.inline(elements))
