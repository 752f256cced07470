"""Not-modified revisits of a web archive (operator 10).

A revisit record says that the server answered "not modified". It is resolved by an as-of join on
the canonical url to the latest earlier full response: validators are compared, and the headers
that such an answer may change are merged into those of the response.

The join needs no window over all captures of a url. Responses are reduced to one per url and
second; a window runs over the seconds of one url and day (86,400 rows at most), and a second one
over the days of a url. Payloads never take part; they are named by record id and digest.

Defined results: a revisit without an earlier response is ``no_original``; a null url or time has
none; of responses in one second the largest record id counts, and a response in the revisit's
own second is not earlier; with both ETags the weak comparison decides, else both Last-Modified,
else the revisit is ``unverified`` and merged; a contradiction is a ``mismatch`` and not merged;
header names are compared in lower case, the first of equal names counts; repeated rows are each
resolved; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that replace those of the response. Fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
DAY = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host in lower case without ``www.`` and default port, query
    sorted. A text without ``://`` has no canonical url."""
    whole = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    end = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    return F.when(rest != "", F.concat(host, path, end))


def plain_headers(headers: Column) -> Column:
    """Header names in lower case; of equal names the first."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def merged_headers(old: Column, new: Column) -> Column:
    changed = F.map_filter(new, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(changed, k)), changed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def status_of(found: Column, etag: Column, old_etag: Column, modified: Column, old_modified: Column) -> Column:
    same_tag, same_time = _weak(etag) == _weak(old_etag), modified == old_modified
    return (
        F.when(~found, "no_original")
        .when(same_tag, "resolved").when(~same_tag, "mismatch")
        .when(same_time, "resolved").when(~same_time, "mismatch")
        .otherwise("unverified")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the response that it repeats.

    ``records``: record_id, kind ("response" or "revisit"), url, captured_at (seconds), etag,
    last_modified, headers (map), payload_digest. Only responses with a payload_digest are full.
    Returns record_id, url, captured_at, status, original_id, original_at, payload_digest, headers.
    """
    known = records.select(
        "record_id", "kind", "url", "captured_at", "etag", "last_modified", "headers", "payload_digest",
        canonical_url(F.col("url")).alias("canonical"))
    full = known.filter("kind = 'response' AND payload_digest IS NOT NULL AND canonical IS NOT NULL "
                        "AND captured_at IS NOT NULL")
    kept = F.struct("record_id", F.col("captured_at").alias("at"), "etag", "last_modified", "headers", "payload_digest")
    # A map cannot be compared, so the largest record id picks the row.
    per_second = full.groupBy("canonical", "captured_at").agg(F.max_by(kept, F.col("record_id")).alias("r"))
    asked = known.filter("kind = 'revisit'")
    moments = asked.filter("canonical IS NOT NULL AND captured_at IS NOT NULL").select(
        "canonical", "captured_at").distinct()
    line = per_second.select("canonical", "captured_at", "r", F.lit(False).alias("ask")).unionByName(
        moments.withColumn("r", F.lit(None).cast(per_second.schema["r"].dataType)).withColumn("ask", F.lit(True)))
    line = line.withColumn("day", F.floor(F.col("captured_at") / DAY))
    # Rows of the revisit's own second, its own among them, lie outside the frame.
    within = Window.partitionBy("canonical", "day").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    in_day = line.withColumn("before", F.last("r", True).over(within)).filter("ask")
    days = line.groupBy("canonical", "day").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("captured_at"))).alias("r"))
    across = Window.partitionBy("canonical").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("canonical", "day", F.last("r", True).over(across).alias("carried"))
    origin = in_day.join(carried, ["canonical", "day"]).select(
        "canonical", "captured_at", F.coalesce("before", "carried").alias("o"))
    found = asked.join(origin, ["canonical", "captured_at"], "left")
    status = status_of(F.col("o").isNotNull(), F.col("etag"), F.col("o.etag"),
                       F.col("last_modified"), F.col("o.last_modified"))
    ok = F.col("status").isin("resolved", "unverified")
    new = F.coalesce(plain_headers(F.col("headers")), F.expr("map()").cast("map<string,string>"))
    old = F.coalesce(plain_headers(F.col("o.headers")), F.expr("map()").cast("map<string,string>"))
    return found.withColumn("status", status).select(
        "record_id", "url", "captured_at", "status", F.col("o.record_id").alias("original_id"),
        F.col("o.at").alias("original_at"), F.when(ok, F.col("o.payload_digest")).alias("payload_digest"),
        F.when(ok, merged_headers(old, new)).alias("headers"))


def with_payloads(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """``resolved`` with the ``payload`` of each original; ``payloads`` has record_id, payload."""
    originals = payloads.select(F.col("record_id").alias("original_id"), "payload")
    joined = resolved.join(originals, "original_id", "left")
    return joined.withColumn("payload", F.when(F.col("payload_digest").isNotNull(), F.col("payload")))


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines of "name: value"."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Records made from a table of pages: a response each and, by page_id, up to three revisits.

    Times, urls in other spellings and validators vary with page_id; every seventh page changes
    its ETag before its revisits, every fifth carries none.
    """
    page = F.col("page_id").cast("long")
    at = F.lit(1_700_000_000) + F.pmod(page * 7_919, F.lit(20_000_000))
    digest = F.md5(F.col("html").cast("binary"))
    tag = F.when(page % 5 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"')))
    base = pages.select(page.alias("page"), "url", at.alias("at"), digest.alias("digest"), tag.alias("tag"))
    lm = F.when(F.col("page") % 10 != 0, F.col("at") - 1_000)
    responses = base.select(
        F.concat(F.lit("r"), F.col("page")).alias("record_id"), F.lit("response").alias("kind"), "url",
        F.col("at").alias("captured_at"), F.col("tag").alias("etag"), lm.alias("last_modified"),
        F.map_from_arrays(F.array(*map(F.lit, ["Content-Type", "ETag", "Cache-Control", "Date"])), F.array(
            F.lit("text/html"), "tag", F.lit("max-age=60"), F.col("at").cast("string"))).alias("headers"),
        F.col("digest").alias("payload_digest"))
    k = F.col("k")
    again = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.pmod(F.col("page"), F.lit(4)).cast("int")))).filter("k > 0")
    url = (F.when(k == 1, F.col("url")).when(k == 2, F.concat("url", F.lit("#again")))
           .otherwise(F.regexp_replace("url", "^http://", "HTTPS://")))
    new_tag = F.when(F.col("page") % 7 == 0, F.lit('"changed"')).when(
        k == 2, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag"))
    revisits = again.withColumn("then", F.col("at") + k * 50_000 - F.when(F.col("page") % 11 == 0, 60_000).otherwise(0)).select(
        F.concat(F.lit("v"), F.col("page"), F.lit("-"), k).alias("record_id"), F.lit("revisit").alias("kind"),
        url.alias("url"), F.col("then").alias("captured_at"), new_tag.alias("etag"), lm.alias("last_modified"),
        F.map_from_arrays(F.array(*map(F.lit, ["content-type", "etag", "Date", "Expires"])), F.array(
            F.lit("message/http"), new_tag, F.col("then").cast("string"), (F.col("then") + 60).cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"))
    return responses.unionByName(revisits)


#: What DuckDB must find for the revisits made by ``captures``.
SQL = r"""
WITH base AS (
  SELECT page_id AS page, url, 1700000000 + (page_id * 7919) % 20000000 AS born, md5(html) AS digest,
         CASE WHEN page_id % 5 <> 0 THEN '"' || substr(md5(html), 1, 12) || '"' END AS tag,
         CASE WHEN page_id % 10 <> 0 THEN 1700000000 + (page_id * 7919) % 20000000 - 1000 END AS lm
  FROM pages
), asked AS (
  SELECT *, born + k * 50000 - CASE WHEN page % 11 = 0 THEN 60000 ELSE 0 END AS t,
         CASE WHEN page % 7 = 0 THEN '"changed"' WHEN k = 2 THEN 'W/' || tag ELSE tag END AS new_tag,
         CASE k WHEN 1 THEN url WHEN 2 THEN url || '#again'
                ELSE regexp_replace(url, '^http://', 'HTTPS://') END AS asked_url
  FROM base, (VALUES (1), (2), (3)) v(k) WHERE k <= page % 4
), cut AS (
  SELECT 'r' AS kind, 'r' || page AS id, url AS u, born AS t, page, NULL AS k FROM base WHERE digest IS NOT NULL
  UNION ALL SELECT 'v', 'v' || page || '-' || k, asked_url, t, page, k FROM asked
), parts AS (
  SELECT *, regexp_extract(regexp_replace(u, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1) AS rest FROM cut
), split AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '\?(.*)$', 1) AS query
  FROM parts
), canon AS (
  SELECT *, CASE WHEN rest <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END ||
         CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS c
  FROM split
), responses AS (
  SELECT c, t, max(id) AS id, arg_max(page, id) AS page FROM canon WHERE kind = 'r' AND c IS NOT NULL GROUP BY c, t
), joined AS (
  SELECT v.id, v.u, v.t, v.page, v.k, r.id AS rid, r.t AS rt, r.page AS rpage
  FROM (SELECT * FROM canon WHERE kind = 'v') v ASOF LEFT JOIN responses r ON v.c = r.c AND v.t > r.t
), judged AS (
  SELECT j.*, a.new_tag, o.tag AS old_tag, o.digest, o.born AS old_at, a.lm,
    CASE WHEN j.rid IS NULL THEN 'no_original'
         WHEN regexp_replace(a.new_tag, '^W/', '') = o.tag THEN 'resolved'
         WHEN regexp_replace(a.new_tag, '^W/', '') <> o.tag THEN 'mismatch'
         WHEN a.lm = o.lm THEN 'resolved' WHEN a.lm <> o.lm THEN 'mismatch' ELSE 'unverified' END AS status
  FROM joined j JOIN asked a ON a.page = j.page AND a.k = j.k LEFT JOIN base o ON o.page = j.rpage
)
SELECT id AS record_id, u AS url, t AS captured_at, status, rid AS original_id, rt AS original_at,
  CASE WHEN status IN ('resolved', 'unverified') THEN digest END AS payload_digest,
  CASE WHEN status IN ('resolved', 'unverified') THEN
    'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) ||
    'etag: ' || coalesce(new_tag, old_tag, '') || chr(10) || 'expires: ' || (t + 60) END AS headers
FROM judged
"""
