"""The given tables seen as notices, fetch logs and a small web of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.config import SHIPPED_CLEANING, Cleaning
from noticelake.functions.dates import normalize_date
from noticelake.functions.text import clean_title
from noticelake.operators.rows import identify
from noticelake.session import scratch_path, spread

# The run date of all queries that need one.
AS_OF = "2001-07-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw_date(key: Column, date: Column) -> Column:
    """Five ways of writing a date, by row number."""
    iso = F.date_format(date, "yyyy-MM-dd")
    dotted = F.replace(iso, F.lit("-"), F.lit("."))
    style = key % 5
    return (
        F.when(style == 0, iso)
        .when(style == 1, dotted)
        .when(style == 2, F.replace(iso, F.lit("-"), F.lit("/")))
        .when(style == 3, F.substring(dotted, 3, 8))
        .otherwise(F.concat(dotted, F.lit(".")))
    )


def raw_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's place: one raw notice per order."""
    orders = spread(table(spark, sf_dir, "orders"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("o_orderkey").cast("string")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("campus"),
            F.col("n_name").alias("college"),
            F.col("c_mktsegment").alias("department_id"),
            F.col("c_mktsegment").alias("department_name"),
            F.col("o_orderpriority").alias("board_id"),
            F.col("o_orderpriority").alias("board_name"),
            F.concat(F.lit("  "), "o_orderstatus", F.lit(" notice  "), key, F.lit(" ")).alias(
                "raw_title"
            ),
            _raw_date(F.col("o_orderkey"), F.col("o_orderdate")).alias("raw_date"),
            F.concat(
                F.lit("https://example.com/"), F.lower("n_name"), F.lit("/view/"), key
            ).alias("link"),
            key.alias("source_id"),
            F.col("o_orderkey").alias("row_pos"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").cast("date").cast("string").alias("true_date"),
        )
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw notices cleaned, dated and identified."""
    return prepare(raw_notices(spark, sf_dir))


def prepare(raw: DataFrame, cleaning: Cleaning = SHIPPED_CLEANING) -> DataFrame:
    ready = (
        raw.withColumn("title", clean_title(F.col("raw_title"), cleaning))
        .withColumn("date", normalize_date(F.col("raw_date")))
        .withColumn("author", F.lit(""))
        .withColumn("is_pinned", F.lit(False))
    )
    return identify(ready)


def earlier_run(df: DataFrame) -> DataFrame:
    """The notices known before 2001."""
    return df.filter("true_date < '2001-01-01'")


def later_run(df: DataFrame) -> DataFrame:
    """The notices since July 1995, urgent ones retitled."""
    retitled = F.when(
        F.col("board_id") == "1-URGENT", F.concat(F.col("title"), F.lit(" (changed)"))
    ).otherwise(F.col("title"))
    return df.filter("true_date >= '1995-07-01'").withColumn("title", retitled)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a fetch log; the type of an event decides the kind of answer."""
    e = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(kind == "error", F.when(k < 30, 503).when(k < 60, 429).otherwise(404))
        .when((kind == "signup") & (k < 50), 304)
        .otherwise(200)
    )
    content = (
        F.when(kind == "purchase", F.when(k < 50, "application/pdf"))
        .when(kind == "view", "application/xhtml+xml")
        .otherwise("text/html; charset=utf-8")
    )
    length = (F.col("value") * 100000).cast("long")
    transport = F.when((kind == "click") & (k >= 90), "timeout").when(
        (kind == "click") & (k >= 85), "decode"
    )
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        status.alias("status"),
        content.alias("content_type"),
        length.alias("content_length"),
        transport.alias("transport_error"),
    )


# A web derived from orders. A campus is a range of 1,000 order keys, a department a customer
# with orders in it, a board a priority, a notice an order; so no page exceeds 1,000 entries.

_HOME = ("http://d", ".example.ac.kr/")


def _site_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    block = F.floor(F.col("o_orderkey") / 1000).cast("long")
    host = F.concat("c_custkey", F.lit("b"), block)
    key = F.col("o_orderkey").cast("string")
    title = F.when(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), F.lit(" 공지 ")
    ).otherwise(F.concat(F.lit("\n 공지 "), "o_orderstatus", F.lit("  &amp; notice "), key))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        block.alias("block"),
        F.col("c_custkey").alias("custkey"),
        "c_name",
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit(_HOME[0]), host, F.lit(_HOME[1])).alias("home"),
        title.alias("title"),
        _raw_date(F.col("o_orderkey"), F.col("o_orderdate")).alias("date"),
    )


def _ordered(order: str, text: Column) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(items, lambda i: i["t"]), "")


def _seed_pages(o: DataFrame) -> DataFrame:
    d = o.select("block", "custkey", "c_name", "segment", "home").distinct()
    segment, name, home = F.col("segment"), F.col("c_name"), F.col("home")
    entry = (
        F.when(
            segment == "BUILDING",
            F.format_string("<h1>BUILDING대학 %s 홈페이지</h1><p><a href=\"%s\">홈페이지</a>", name, home),
        )
        .when(
            segment == "AUTOMOBILE",
            F.format_string("<h1>%s 교수진</h1><p><a href=\"#top\">홈페이지</a></p>", name),
        )
        .when(
            segment == "MACHINERY",
            F.format_string(
                "<h1>MACHINERY 융합대학</h1><h1>%s</h1><a href=\"%s\">학과 홈페이지</a>"
                "<a href=\"http://other.example.com/\">홈페이지</a>",
                name,
                home,
            ),
        )
        .otherwise(
            F.format_string(
                "<h1>%s</h1><a href=\"/x\">소개</a><a href=\"%s\">홈페이지 바로가기</a>", name, home
            )
        )
    )
    return d.groupBy("block").agg(_ordered("custkey", entry).alias("body")).select(
        F.concat(F.lit("https://www.example.ac.kr/seed/"), "block").alias("url"),
        F.concat(
            F.lit("<html><body><nav><h1>바깥대학 밖</h1></nav><main>"), "body",
            F.lit("</main></body></html>"),
        ).alias("html"),
    )


_LINK_TEXT = {
    "1-URGENT": "장학공지",
    "2-HIGH": "공지사항",
    "3-MEDIUM": "취업 정보",
    "4-NOT SPECIFIED": "About us",
    "5-LOW": "알림",
}


def _board_path() -> Column:
    ext = F.when(
        (F.col("priority") == "1-URGENT") & (F.col("segment") != "BUILDING"), F.lit(".do")
    ).otherwise(F.lit(""))
    return F.concat(F.lit("board/"), F.substring("priority", 1, 1), ext)


def _home_pages(o: DataFrame) -> DataFrame:
    b = o.groupBy("home", "segment", "priority").agg(
        F.max((F.col("status") == "F").cast("int")).alias("f")
    )
    text = F.create_map(*[F.lit(x) for kv in _LINK_TEXT.items() for x in kv])[F.col("priority")]
    link = F.concat(
        F.lit("<li><a href=\"/"), _board_path(), F.lit("\"> "), text, F.lit(" </a>")
    )
    pages = b.groupBy("home", "segment").agg(
        _ordered("priority", link).alias("links"), F.max("f").alias("f")
    )
    mark = F.when(F.col("segment") == "BUILDING", F.lit("<div class=\"yon_board\"></div>")).otherwise(
        F.lit("")
    )
    site = F.when(F.col("f") == 1, F.lit("<a href=\"sitemap\">사이트맵</a>")).otherwise(
        F.lit("<a href=\"nowhere\">Sitemap</a>")
    )
    noise = F.lit(
        "<a href=\"javascript:void(0)\">공지</a><a href=\"#\">공지</a>"
        "<a href=\"https://else.example.com/b\">공지사항</a><a href=\"/list?mode=view\">장학</a>"
        "<a href=\"/long\">아주 길어서 게시판 이름일 수 없는 공지 링크</a><a name=\"x\">공지</a>"
    )
    return pages.select(
        F.col("home").alias("url"),
        F.concat(F.lit("<html><body>"), mark, F.lit("<ul>"), "links", F.lit("</ul>"), noise, site)
        .alias("html"),
    )


def _sitemap_pages(o: DataFrame) -> DataFrame:
    with_f = o.filter("status = 'F'").select("home").distinct()
    return with_f.select(
        F.concat("home", F.lit("sitemap")).alias("url"),
        F.lit("<a href=\"/extra\">공지 모음</a><a href=\"extra2\">공지 둘</a><a href=\"/board/2\">공지 셋</a>")
        .alias("html"),
    )


def _board_pages(o: DataFrame) -> DataFrame:
    title, date = F.col("title"), F.col("date")
    link = F.concat(F.lit("/view/"), F.col("orderkey").cast("string"))
    layout = (
        F.when(F.col("segment") == "BUILDING", "nx")
        .when(F.col("priority") == "1-URGENT", "standard")
        .when(F.col("priority") == "2-HIGH", "xe")
        .otherwise("plain")
    )
    forms = {
        "nx": (
            "<div class=yon_board><table class=\"bl_list x\"><tr><th>t</th></tr>",
            "<tr><td class=\"no td-subject\"><a href=\"%s\">%s</a></td><td class=\"td-date\"> %s </td></tr>",
            "</table></div>",
        ),
        "standard": (
            "<table><tr><th>t<th>d</tr>",
            "<tr><td>1<td><a class=\"c-board-title\" href=\"%s\">%s</a><td>작성일 %s</tr>",
            "</table>",
        ),
        "xe": (
            "<ul class=xe-list-board><li class=\"xe-list-board-list--item xe-list-board-list--header\">"
            "<a class=xe-list-board-list__title-link href=\"/h\">t</a>"
            "<b class=xe-list-board-list__created_at>d</b>",
            "<li class=\"xe-list-board-list--item\"><a class=\"xe-list-board-list__title-link\" "
            "href=\"%s\"><span>%s</span></a><i class=\"xe-list-board-list__created_at\">%s</i>",
            "</ul>",
        ),
        "plain": (
            "<table><tr><td>no link</td><td>d</td></tr>",
            "<tr><td><a href=\"%s\">%s</a></td><td>%s</td></tr>",
            "</table>",
        ),
    }
    row = F.coalesce(
        *[F.when(layout == n, F.format_string(f[1], link, title, date)) for n, f in forms.items()]
    )
    head = F.coalesce(*[F.when(layout == n, F.lit(f[0])) for n, f in forms.items()])
    tail = F.coalesce(*[F.when(layout == n, F.lit(f[2])) for n, f in forms.items()])
    pages = o.groupBy("home", "segment", "priority").agg(_ordered("orderkey", row).alias("rows"))
    return pages.select(
        F.concat("home", _board_path()).alias("url"), F.concat(head, "rows", tail).alias("html")
    )


def site_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.floor(F.col("o_orderkey") / 1000).cast("long").cast("string")
    blocks = table(spark, sf_dir, "orders").select(block.alias("b")).distinct()
    return blocks.select(
        F.concat(F.lit("campus-"), "b").alias("campus"),
        F.concat(F.lit("https://www.example.ac.kr/seed/"), "b").alias("url"),
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Four kinds of pages are made of these rows: customers are joined once.
    path = scratch_path(spark, "site-orders")
    _site_orders(spark, sf_dir).write.option("compression", "zstd").parquet(path)
    o = spark.read.parquet(path)
    pages = (
        _seed_pages(o)
        .unionByName(_home_pages(o))
        .unionByName(_sitemap_pages(o))
        .unionByName(_board_pages(o))
    )
    return pages.select(F.xxhash64("url").alias("page_id"), "url", "html")
