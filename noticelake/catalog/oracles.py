"""SQL with the same results as the queries, for an independent engine on the same tables."""

from __future__ import annotations

from noticelake.catalog.views import AS_OF
from noticelake.functions.text import STOPWORDS

ORACLES: dict[str, str] = {}

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def _date_styles(key: str) -> str:
    return f"""CASE {key} % 5
         WHEN 0 THEN concat(y, '-', m, '-', d)
         WHEN 1 THEN concat(y, '.', m, '.', d)
         WHEN 2 THEN concat(y, '/', m, '/', d)
         WHEN 3 THEN concat(substr(y, 3, 2), '.', m, '.', d)
         ELSE concat(y, '.', m, '.', d, '.') END"""


_ORDERS = """(SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y,
             lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS m,
             lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS d FROM orders)"""

_RAW = f"""raw AS (
SELECT r_name AS campus, n_name AS college, c_mktsegment AS department_id,
       c_mktsegment AS department_name, o_orderpriority AS board_id, o_orderpriority AS board_name,
       concat('  ', o_orderstatus, ' notice  ', CAST(o_orderkey AS VARCHAR), ' ') AS raw_title,
       {_date_styles('o_orderkey')} AS raw_date,
       concat('https://example.com/', lower(n_name), '/view/', CAST(o_orderkey AS VARCHAR)) AS link,
       CAST(o_orderkey AS VARCHAR) AS source_id, o_orderkey AS row_pos,
       o_orderstatus AS status, concat(y, '-', m, '-', d) AS true_date
FROM {_ORDERS} o JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _dated(source: str, name: str) -> str:
    """CTE ``name``: ``source`` plus title, date and identity."""
    return f"""{name}_f AS (
SELECT *, CASE WHEN len(string_split(c, '-')) = 3 AND strlen(string_split(c, '-')[1]) = 2
            THEN concat('20', c) ELSE c END AS f
FROM (SELECT *, translate(raw_date, './', '--') AS c FROM {source})),
{name}_d AS (
SELECT *, CASE WHEN regexp_full_match(f, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
                AND try_strptime(f, '%Y-%m-%d') IS NOT NULL
          THEN strftime(try_strptime(f, '%Y-%m-%d'), '%Y-%m-%d') ELSE f END AS date,
       trim(replace(replace(trim(regexp_replace(raw_title, '\\s+', ' ', 'g')), '첨부파일', ''), '공지', ''))
         AS title,
       sha256(concat_ws('|', lower(campus), lower(department_id), lower(board_id),
                        lower(source_id), lower(link))) AS digest FROM {name}_f),
{name}_k AS (
SELECT *, concat(replace(date, '-', ''), '-', substr(digest, 1, 6)) AS id,
       concat(replace(date, '-', ''), '-', digest) AS notice_key,
       CASE WHEN regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
            THEN try_cast(date AS DATE) END AS day FROM {name}_d),
{name} AS (
SELECT *, year(coalesce(day, DATE '{AS_OF}')) AS year, month(coalesce(day, DATE '{AS_OF}')) AS month
FROM {name}_k)"""


_N = f"WITH {_RAW}, {_dated('raw', 'n')}"
_FEED = "id, title, campus, department_name, board_name, date, link"
_HOT = f"(year = {int(AS_OF[:4])} AND month = {int(AS_OF[5:7])})"

_RUNS = f"""{_N},
before_ AS (SELECT * FROM n WHERE true_date < '2001-01-01'),
now_ AS (SELECT * REPLACE (CASE WHEN board_id = '1-URGENT' THEN concat(title, ' (changed)')
                           ELSE title END AS title)
        FROM n WHERE true_date >= '1995-07-01')"""

ORACLES["q01_feed"] = f"""{_N} SELECT {_FEED} FROM n
WHERE campus = 'ASIA' AND department_name = 'BUILDING' AND board_name = '1-URGENT'
  AND contains(lower(title), 'f notice') ORDER BY date DESC, notice_key LIMIT 100"""
ORACLES["q01b_feed_asc"] = f"""{_N} SELECT {_FEED} FROM n WHERE campus = 'EUROPE'
ORDER BY date, notice_key LIMIT 100"""
ORACLES["q01c_search_title"] = f"""{_N} SELECT notice_key, title FROM n
WHERE contains(lower(title), 'o notice 1')"""
ORACLES["q01d_apply_filters"] = f"""{_N}
SELECT campus, department_name, board_name, count(*) AS notices FROM n
WHERE campus = 'AMERICA' AND board_name = '5-LOW' GROUP BY ALL"""
ORACLES["q02_facets"] = f"""WITH {_RAW}
SELECT DISTINCT 'campus' AS facet, campus AS value FROM raw
UNION ALL SELECT DISTINCT 'department', department_name FROM raw WHERE campus = 'ASIA'
UNION ALL SELECT DISTINCT 'board', board_name FROM raw
  WHERE campus = 'ASIA' AND department_name = 'MACHINERY'
UNION ALL SELECT DISTINCT 'all departments', department_name FROM raw"""
ORACLES["q02b_facet_tree"] = f"""WITH {_RAW}
SELECT DISTINCT campus, department_name, board_name FROM raw"""
ORACLES["q03_notice_stats"] = f"""WITH {_RAW}
SELECT count(*) AS total, count(DISTINCT campus) AS campuses,
       count(DISTINCT department_name) AS departments, count(DISTINCT board_name) AS boards,
       count(DISTINCT college) AS colleges FROM raw"""
ORACLES["q03b_date_range"] = f"""{_N}
SELECT coalesce(min(nullif(date, '')), '') AS earliest,
       coalesce(max(nullif(date, '')), '') AS latest FROM n"""
ORACLES["q03c_latest_date"] = f"""{_N} SELECT coalesce(max(nullif(date, '')), '') AS latest FROM n"""
ORACLES["q04_normalize_dates"] = f"""{_N}, stripped AS (
SELECT row_pos, regexp_replace(raw_date, '[./-]+$', '') AS raw_date, raw_title, campus,
       department_id, board_id, source_id, link FROM raw),
{_dated('stripped', 's')}
SELECT n.row_pos, n.date, CAST(n.year AS BIGINT) AS year, CAST(n.month AS BIGINT) AS month,
       s.date AS date_stripped FROM n JOIN s USING (row_pos)"""
ORACLES["q05_canonical_id"] = f"""{_N}
SELECT row_pos, id, notice_key, regexp_extract(link, '/view/([0-9]+)', 1) AS link_id FROM n"""
ORACLES["q05b_id_collisions"] = f"""{_N}
SELECT id, count(*) AS notices FROM n GROUP BY id HAVING count(*) > 1"""
ORACLES["q06_dedupe_first"] = f"""WITH {_RAW}, twice AS (
SELECT *, 0 AS board_ord FROM raw UNION ALL
SELECT * REPLACE (
    CASE WHEN status = 'F' THEN '' ELSE source_id END AS source_id,
    CASE WHEN status = 'F' THEN concat('https://example.com/', lower(college)) ELSE link END AS link,
    CASE WHEN status = 'F' THEN '2001-01-01' ELSE raw_date END AS raw_date,
    concat('copy ', raw_title) AS raw_title), 1 FROM raw), {_dated('twice', 't')}
SELECT notice_key, title, board_ord, row_pos FROM t WHERE title <> ''
QUALIFY row_number() OVER (PARTITION BY notice_key ORDER BY board_ord, row_pos) = 1"""

_CHANGES = f"""{_RUNS}, changes AS (
SELECT 'added' AS change, notice_key, id, title, campus FROM now_
 WHERE notice_key NOT IN (SELECT notice_key FROM before_)
UNION ALL SELECT 'removed', notice_key, id, NULL, NULL FROM before_
 WHERE notice_key NOT IN (SELECT notice_key FROM now_)
UNION ALL SELECT 'updated', w.notice_key, w.id, w.title, w.campus
 FROM now_ w JOIN before_ b ON w.notice_key = b.notice_key AND w.title <> b.title)"""
ORACLES["q07_change_feed"] = f"{_CHANGES} SELECT * FROM changes"
ORACLES["q07b_change_counts"] = f"""{_CHANGES}
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated,
       count(*) FILTER (change = 'removed') AS removed, count(*) AS change_count,
       count(*) > 0 AS has_changes FROM changes"""
ORACLES["q07c_change_feed_without_updates"] = f"""{_CHANGES}
SELECT change, count(*) AS notices FROM changes WHERE change <> 'updated' GROUP BY change"""
ORACLES["q07d_unchanged_ids"] = f"""{_RUNS}
SELECT notice_key FROM now_ INTERSECT SELECT notice_key FROM before_"""
ORACLES["q07e_only_in_current"] = f"""{_RUNS} SELECT notice_key, title FROM now_
WHERE notice_key NOT IN (SELECT notice_key FROM before_)"""


def _verdict(counts: str) -> str:
    return f"""SELECT *, status IN ('safe', 'cold_start') AS proceed FROM (
SELECT *, CASE WHEN current_count = 0 AND previous_count = 0 THEN 'cold_start'
               WHEN current_count = 0 THEN 'empty_result'
               WHEN previous_count < 10 THEN 'cold_start'
               WHEN drop_percent > 20 THEN 'triggered' ELSE 'safe' END AS status
FROM (SELECT *, CASE WHEN current_count < previous_count THEN
      round((previous_count - current_count) / previous_count::DOUBLE * 100, 6) ELSE 0.0 END
      AS drop_percent FROM ({counts})))"""


ORACLES["q08_circuit_breaker"] = f"""WITH {_RAW}, c AS (
SELECT count(*) AS a, count(*) FILTER (true_date >= '1995-07-01') AS p,
       count(*) FILTER (status <> 'F') AS t FROM raw)
{_verdict('''SELECT 'all, all' AS pair, a AS current_count, a AS previous_count FROM c
UNION ALL SELECT 'part of it', p, a FROM c UNION ALL SELECT 'two of three states', t, a FROM c
UNION ALL SELECT 'nothing', 0, a FROM c UNION ALL SELECT 'more', a, t FROM c
UNION ALL SELECT 'small baseline', (SELECT count(*) FROM nation), (SELECT count(*) FROM region)
UNION ALL SELECT 'first run', a, 0 FROM c UNION ALL SELECT 'both empty', 0, 0''')}"""
ORACLES["q09_month_partition"] = f"""{_N}
SELECT CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, {_HOT} AS is_hot,
       count(*) AS notices FROM n GROUP BY ALL"""
ORACLES["q10_archive_merge"] = f"""{_RUNS}
SELECT notice_key, title, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month FROM (
SELECT *, 0 AS o FROM before_ UNION ALL SELECT *, 1 FROM now_) WHERE NOT {_HOT}
QUALIFY row_number() OVER (PARTITION BY notice_key ORDER BY o) = 1"""
ORACLES["q10b_read_archives"] = f"""{_N}
SELECT notice_key, date, title FROM n
WHERE (year = 2001 AND month IN (5, 6)) OR (year = 2000 AND month = 12)"""
ORACLES["q11_month_backfill"] = f"""{_N},
hot AS (SELECT * FROM n WHERE {_HOT} OR (year = 2001 AND month = 6 AND status = 'F')),
cold AS (SELECT *, year * 12 + month AS ym FROM n WHERE NOT {_HOT}),
oldest AS (SELECT min(year(day) * 12 + month(day)) AS ym FROM hot WHERE day IS NOT NULL),
months AS (SELECT DISTINCT oldest.ym - cold.ym AS page, cold.ym AS ym FROM cold, oldest
           WHERE cold.ym < oldest.ym),
run AS (SELECT page, ym FROM months QUALIFY row_number() OVER (ORDER BY page) = page),
pages AS (SELECT notice_key, date, link, 0 AS page FROM hot UNION ALL
          SELECT notice_key, date, link, page FROM cold JOIN run USING (ym))
SELECT notice_key, date, CAST(page AS BIGINT) AS page FROM pages
QUALIFY page = min(page) OVER (PARTITION BY link, date)"""
ORACLES["q11b_load_month"] = f"""{_RUNS} SELECT notice_key, title FROM now_ w
WHERE NOT EXISTS (SELECT 1 FROM before_ b WHERE b.link = w.link AND b.date = w.date)"""


def _tokens(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"[x FOR x IN {words} IF strlen(x) >= 2 AND x NOT IN {_STOP}]"


_PART_POSTINGS = f"""part_tokens AS (
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, list_concat(
  {_tokens('p_name')}, {_tokens('p_type')}, {_tokens('p_brand')},
  {_tokens("'the board'")}) AS t FROM part),
postings AS (SELECT DISTINCT unnest(t) AS token, id FROM part_tokens)"""
ORACLES["q12_inverted_index"] = f"WITH {_PART_POSTINGS} SELECT token, id FROM postings"
_DOC_TITLE = "regexp_replace(text, '[^\\p{L}\\p{Nd}]+', ' ', 'g')"
_DOC_TOKENS = f"list_concat({_tokens(_DOC_TITLE)}, {_tokens('lang')}, {_tokens('source')})"
ORACLES["q12b_index_documents"] = f"""SELECT DISTINCT unnest(t) AS token, id FROM (
SELECT CAST(doc_id AS VARCHAR) AS id, {_DOC_TOKENS} AS t FROM documents)"""
ORACLES["q12g_capped_tokens"] = f"""SELECT DISTINCT unnest(t) AS token, id FROM (
SELECT CAST(doc_id AS VARCHAR) AS id, list_slice({_DOC_TOKENS}, 1, 50) AS t FROM documents)"""
ORACLES["q12f_long_tokens"] = """WITH n AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS x FROM documents)
SELECT doc_id, CAST(CASE WHEN 2000 * (length(array_to_string(x, ',')) + 1) - 1 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS words,
  CAST(2000 * (length(array_to_string(x, ',')) + 1) - 1 AS BIGINT) AS length FROM n WHERE len(x) > 0"""
ORACLES["q12c_document_frequency"] = f"""SELECT token, count(*) AS doc_freq FROM (
SELECT DISTINCT doc_id, unnest({_tokens(_DOC_TITLE)}) AS token FROM documents) GROUP BY token"""
ORACLES["q12d_index_header"] = f"""WITH {_PART_POSTINGS}
SELECT 1 AS version, (SELECT count(*) FROM part) AS notice_count,
       count(DISTINCT token) AS token_count FROM postings"""
ORACLES["q12e_export_index"] = f"""WITH {_PART_POSTINGS}
SELECT token, count(*) AS doc_freq, string_agg(id, ',' ORDER BY id) AS ids FROM postings GROUP BY token"""
ORACLES["q13b_search_stored_index"] = f"""{_N} SELECT notice_key, title FROM n
WHERE regexp_matches(lower(title), '\\bnotice\\b') AND campus = 'ASIA' AND department_name = 'BUILDING'"""
ORACLES["q13c_search_three_runs"] = f"""{_RUNS}, runs AS (
SELECT 'r1' AS run_id, title, campus, department_name, notice_key FROM before_
UNION ALL SELECT 'r2', CASE WHEN true_date >= '2000-10-01' THEN 'notice of other words' ELSE title END,
  campus, department_name, notice_key FROM before_ WHERE true_date >= '1992-03-01'
UNION ALL SELECT 'r3', title, campus, department_name, notice_key FROM now_)
SELECT run_id, 'changed notice asia' AS query, notice_key FROM runs
WHERE contains(title, '(changed)') AND contains(title, 'notice') AND campus = 'ASIA'
UNION ALL SELECT run_id, 'other words building', notice_key FROM runs
WHERE contains(title, 'other words') AND department_name = 'BUILDING'"""
ORACLES["q13_index_search"] = f"""WITH {_PART_POSTINGS}
SELECT id, title FROM part_tokens WHERE id IN (
SELECT id FROM postings WHERE token IN ('small', 'ring') GROUP BY id HAVING count(*) = 2)"""

# Pages. Their links are plain <a href="...">text</a>, all root-relative and without entities.
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_HOST = "regexp_extract(url, '^https?://([^/?#:]*)', 1)"
_LINKS = f"""links AS (
SELECT page_id, url, CAST(i - 1 AS BIGINT) AS pos, trim(texts[i]) AS text, hrefs[i] AS href,
       concat({_ORIGIN}, replace(replace(url_encode(hrefs[i]), '%2F', '/'), '%2C', ',')) AS link_url
FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages)))"""
_GOOD = """good AS (SELECT * FROM links WHERE NOT contains(href, 'tion') AND NOT contains(href, '/st')
  AND length(text) <= 12)"""
ORACLES["q14_extract_links"] = f"WITH {_LINKS} SELECT page_id, pos, text, href, link_url FROM links"
ORACLES["q14b_link_rules"] = f"""WITH {_LINKS}
SELECT page_id, pos, NOT contains(href, 'the') AND NOT contains(href, '/de') AS listed,
       length(text) <= 5 AS short, NOT contains(href, 'javascript') AND href <> '#' AS navigable,
       true AS same_host, {_HOST} AS host FROM links"""
ORACLES["q14c_board_links"] = f"WITH {_LINKS}, {_GOOD} SELECT page_id, pos, text, href FROM good"
ORACLES["q14d_elements"] = f"""WITH {_LINKS},
per_page AS (SELECT page_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
             FROM links GROUP BY page_id)
SELECT page_id, tag, CASE WHEN tag IN ('a', 'li') THEN n ELSE 1 END AS elements, chars AS text_length
FROM per_page, (VALUES ('a'), ('li'), ('ul'), ('nav')) AS t(tag)
UNION ALL SELECT page_id, 'h1', 1,
  length(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) FROM pages"""
ORACLES["q15_dedupe_links"] = f"""WITH {_LINKS}
SELECT {_HOST} AS host, href, page_id, pos FROM links
QUALIFY row_number() OVER (PARTITION BY {_HOST}, link_url ORDER BY page_id, pos) = 1"""
ORACLES["q16_keyword_boards"] = f"""WITH {_LINKS}, {_GOOD},
first_links AS (SELECT * FROM good
  QUALIFY row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) = 1),
kept AS (SELECT *, CASE WHEN contains(text, 'the') THEN 'academic' WHEN contains(text, 'en') THEN 'notice'
  WHEN contains(text, 'in') THEN 'notice' WHEN contains(text, 'a') THEN 'career' END AS b
  FROM first_links),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id, b ORDER BY pos) AS k
             FROM kept WHERE b IS NOT NULL)
SELECT page_id, pos, CASE WHEN k > 1 THEN concat(b, '_', k) ELSE b END AS board_id,
       text AS board_name FROM numbered"""
_CMS = """CASE WHEN contains(url, 'page=') THEN 'paged' WHEN contains(lower(html), '$$$ ') THEN 'quoted'
  WHEN contains(url, '/fr/') OR contains(lower(html), 'lang="fr"') THEN 'french' END"""
ORACLES["q17_detect_cms"] = f"""SELECT page_id, cms, CASE cms WHEN 'paged' THEN 'ul li'
  WHEN 'quoted' THEN 'li:has(a)' WHEN 'french' THEN 'nav li' END AS row_selector
FROM (SELECT page_id, {_CMS} AS cms FROM pages)"""
ORACLES["q17b_resolve_selectors"] = f"""SELECT page_id,
  CASE cms WHEN 'paged' THEN 'ul li' WHEN 'quoted' THEN 'li:has(a)' WHEN 'french' THEN 'nav li'
       ELSE 'table tr:has(a)' END AS row_selector,
  CASE cms WHEN 'quoted' THEN 'li a' ELSE 'a' END AS title_selector,
  CASE WHEN cms IS NULL THEN 'td:last-child' ELSE 'a' END AS date_selector, 'href' AS attr_name
FROM (SELECT page_id, {_CMS} AS cms FROM pages)"""
ORACLES["q19_merge_sources"] = f"""WITH {_LINKS}
SELECT {_HOST} AS host, href, CASE WHEN url LIKE 'https%' THEN 0::BIGINT ELSE 1::BIGINT END AS source_prio,
       page_id * 1000 + pos AS pos FROM links
QUALIFY row_number() OVER (PARTITION BY {_HOST}, link_url
  ORDER BY CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END, page_id * 1000 + pos) = 1"""

_FETCH = """log AS (
SELECT event_id, event_type, user_id, k,
  CASE WHEN event_type = 'error' THEN CASE WHEN k < 30 THEN 503 WHEN k < 60 THEN 429 ELSE 404 END
       WHEN event_type = 'signup' AND k < 50 THEN 304 ELSE 200 END AS status,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN 'application/pdf' END
       ELSE 'text/html' END AS content_type,
  CAST(trunc(value * 100000) AS BIGINT) AS content_length,
  CASE WHEN event_type = 'click' AND k >= 90 THEN 'timeout'
       WHEN event_type = 'click' AND k >= 85 THEN 'decode' END AS transport
FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events)),
judged AS (SELECT *, CASE WHEN transport IS NOT NULL THEN 'transport' WHEN status = 304 THEN 'not_modified'
  WHEN status <> 200 THEN 'upstream_http' WHEN content_type = 'application/pdf' THEN 'unexpected_content_type'
  WHEN content_length > 2000000 THEN 'body_too_large' ELSE 'ok' END AS outcome FROM log),
outcomes AS (SELECT *, (outcome = 'upstream_http' AND status IN (503, 429))
  OR (outcome = 'transport' AND transport = 'timeout') AS retryable FROM judged)"""
ORACLES["q20_classify_fetch"] = f"WITH {_FETCH} SELECT event_id, outcome, retryable FROM outcomes"
ORACLES["q21_run_stats"] = f"""WITH {_FETCH}
SELECT event_type, count(*) AS board_total, count(*) FILTER (outcome <> 'ok') AS board_failures,
       round(count(*) FILTER (outcome = 'ok') / count(*)::DOUBLE, 9) AS board_success_rate
FROM outcomes GROUP BY event_type"""
ORACLES["q21b_error_report"] = f"""WITH {_FETCH}
SELECT 'board_list' AS stage, retryable, count(*) AS errors FROM outcomes
WHERE outcome <> 'ok' GROUP BY ALL"""
ORACLES["q21c_board_lookup"] = f"""{_RUNS}
SELECT 'board_lookup' AS stage, id AS notice_id, concat('Board with id ', board_id, ' not found') AS message,
       false AS retryable FROM n
WHERE (campus, department_id, board_id) NOT IN (
  SELECT (campus, department_id, board_id) FROM before_ WHERE campus <> 'ASIA')"""
_HIER = f"""{_RAW}, boards AS (SELECT DISTINCT campus,
  CASE WHEN department_id = 'BUILDING' THEN '' ELSE college END AS college, department_id, board_id FROM raw)"""
ORACLES["q22_hierarchy"] = f"""WITH {_HIER}
SELECT campus, college, department_id, board_id,
  concat_ws('/', 'https://example.com', campus, college, department_id, board_id) AS board_url,
  'table tr:has(a)' AS row_selector, 'href' AS attr_name, NULL::VARCHAR AS author_selector FROM boards"""
ORACLES["q22b_hierarchy_counts"] = f"""WITH {_HIER}
SELECT campus, count(DISTINCT (college, department_id)) AS departments, count(*) AS boards
FROM boards GROUP BY campus"""
ORACLES["q22c_nested_notices"] = f"""{_N}
SELECT id, title, link, campus, college, department_name, board_name, date, false AS is_pinned FROM n"""
_WS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NORM = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"
ORACLES["q23_clean_text"] = f"""SELECT doc_id, md5({_NORM}) AS normalized,
  md5(trim(replace(replace({_NORM}, 'the ', ''), 'on', ''))) AS title,
  md5(trim(replace(replace(replace({_NORM}, 'an', ''), '. ', '.'), ',', ';'))) AS date,
  md5(regexp_replace(string_split(string_split(text, 'the')[1], 'ing')[1], '^{_WS}+|{_WS}+$', '', 'g')) AS header
FROM documents"""
ORACLES["q24_manual_review"] = f"""WITH {_LINKS}, {_GOOD},
have AS (SELECT DISTINCT page_id FROM good WHERE contains(text, 'the') OR contains(text, 'en')
  OR contains(text, 'in') OR contains(text, 'a')),
departments AS (SELECT page_id, url AS page_url, {_HOST} AS campus,
  CASE WHEN contains(url, '/fr/') THEN concat(url, '/gone') WHEN contains(url, '/de/') THEN 'NOT_FOUND'
       WHEN contains(url, '/es/') THEN concat('ftp:', url) ELSE url END AS url FROM pages)
SELECT campus, concat('page ', page_id) AS name, url, reason FROM (
SELECT *, CASE WHEN url = 'NOT_FOUND' OR url NOT LIKE 'http%' THEN 'Homepage URL is invalid'
  WHEN url NOT IN (SELECT url FROM pages) THEN 'Failed to fetch homepage'
  WHEN page_id NOT IN (SELECT page_id FROM have) THEN 'No boards discovered from homepage or sitemap'
  END AS reason FROM departments) WHERE reason IS NOT NULL"""
ORACLES["q24b_departments_of_urls"] = """SELECT page_id, true AS valid, concat('dept_',
  coalesce(nullif(lower(regexp_extract(url, 'https?://([^.]+)\\.example\\.com', 1)), ''),
           concat('page_no_', page_id))) AS department_id FROM pages"""
_TITLE = "trim(replace(replace(trim(text), 'the', ''), 'de', ''))"
_LISTED = f"""{_LINKS}, rows_ AS (SELECT *, {_TITLE} AS title FROM links WHERE NOT contains(url, '/fr/'))"""
ORACLES["q26_extract_rows"] = f"""WITH {_LISTED}
SELECT CAST(page_id AS VARCHAR) AS department_id, pos AS row_pos, title, trim(text) AS date,
       '' AS author, link_url AS link FROM rows_ WHERE title <> ''"""
ORACLES["q26b_row_accounting"] = f"""WITH {_LISTED}
SELECT CAST(page_id AS VARCHAR) AS department_id, count(*) AS row_total,
       count(*) FILTER (title = '') AS row_failures FROM rows_ GROUP BY page_id"""
ORACLES["q26c_selector_errors"] = """SELECT 'selector' AS stage, url, concat('unsupported selector: ',
  CASE WHEN contains(url, '/fr/') THEN 'nav::li' ELSE 'a:hover' END) AS message, false AS retryable
FROM pages WHERE contains(url, '/fr/') OR contains(url, '/de/')"""

ORACLES["q27_commit"] = f"""{_RUNS},
filled AS (SELECT * FROM now_ WHERE status = 'F'),
words AS (SELECT o, unnest(list_concat({_tokens('title')}, {_tokens('campus')},
  {_tokens('department_name')}, {_tokens('board_name')}, {_tokens('college')})) AS w
  FROM (SELECT 1 AS o, * FROM before_ UNION ALL SELECT 3, * FROM now_)),
facts AS (
SELECT 'r1' AS run_id, 0 AS seq, (SELECT count(*) FROM before_) AS current_count, 0 AS previous_count
UNION ALL SELECT 'r2', 1, (SELECT count(*) FROM filled), (SELECT count(*) FROM before_)
UNION ALL SELECT 'r3', 2, (SELECT count(*) FROM now_), (SELECT count(*) FROM before_)),
more AS (
SELECT 'r1' AS run_id, (SELECT count(*) FROM before_ WHERE {_HOT}) AS hot_count,
  (SELECT count(DISTINCT (year, month)) FROM before_ WHERE NOT {_HOT}) AS cold_months,
  (SELECT count(*) FROM before_) AS added, 0 AS updated, 0 AS removed,
  (SELECT count(*) FROM before_) AS index_notice_count,
  (SELECT count(DISTINCT w) FROM words WHERE o = 1) AS index_token_count
UNION ALL SELECT 'r2', 0, 0, NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 'r3', (SELECT count(*) FROM now_ WHERE {_HOT}),
  (SELECT count(DISTINCT (year, month)) FROM (SELECT year, month FROM now_ WHERE NOT {_HOT} UNION ALL
     SELECT year, month FROM before_ WHERE {_HOT} AND notice_key NOT IN (SELECT notice_key FROM now_))),
  (SELECT count(*) FROM now_ WHERE notice_key NOT IN (SELECT notice_key FROM before_)),
  (SELECT count(*) FROM now_ w JOIN before_ b USING (notice_key) WHERE w.title <> b.title),
  (SELECT count(*) FROM before_ WHERE notice_key NOT IN (SELECT notice_key FROM now_)),
  (SELECT count(*) FROM now_), (SELECT count(DISTINCT w) FROM words WHERE o = 3))
SELECT run_id, CAST(seq AS BIGINT) AS seq, status, proceed AS committed, current_count, previous_count,
  drop_percent, hot_count, cold_months, CAST(added AS BIGINT) AS added, CAST(updated AS BIGINT) AS updated,
  CAST(removed AS BIGINT) AS removed, index_notice_count, index_token_count
FROM ({_verdict('SELECT * FROM facts')}) JOIN more USING (run_id)"""
ORACLES["q27b_feed_after_commit"] = f"""{_RUNS},
hot AS (SELECT * FROM now_ WHERE {_HOT}),
cold AS (SELECT *, year * 12 + month AS ym FROM (
  SELECT *, 0 AS o FROM before_ UNION ALL SELECT *, 1 FROM now_) WHERE NOT {_HOT}
  QUALIFY row_number() OVER (PARTITION BY notice_key ORDER BY o) = 1),
oldest AS (SELECT min(year(day) * 12 + month(day)) AS ym FROM hot WHERE day IS NOT NULL),
months AS (SELECT DISTINCT oldest.ym - cold.ym AS page, cold.ym AS ym FROM cold, oldest
           WHERE cold.ym < oldest.ym),
run AS (SELECT page, ym FROM months QUALIFY row_number() OVER (ORDER BY page) = page)
SELECT notice_key, title, date FROM (
SELECT notice_key, title, date, campus FROM hot UNION ALL
SELECT notice_key, title, date, campus FROM cold JOIN run USING (ym)) WHERE campus = 'ASIA'"""

# The derived web, computed straight from the tables.
_SITE = f"""o AS (SELECT *, o_orderkey // 1000 AS block,
  concat('http://d', c_custkey, 'b', o_orderkey // 1000, '.example.ac.kr/') AS home,
  {_date_styles('o_orderkey')} AS raw_date FROM {_ORDERS} JOIN customer ON o_custkey = c_custkey),
d0 AS (SELECT DISTINCT block, c_custkey, c_name, c_mktsegment AS segment, home FROM o),
d1 AS (SELECT *, concat('campus-', block) AS campus, last_value(CASE segment WHEN 'BUILDING' THEN 'BUILDING대학'
    WHEN 'MACHINERY' THEN 'MACHINERY융합대학' END IGNORE NULLS)
    OVER (PARTITION BY block ORDER BY c_custkey) AS college FROM d0),
dep AS (SELECT campus, college, c_name AS department_name, block, c_custkey, segment, home,
  CASE WHEN segment = 'AUTOMOBILE' THEN 'NOT_FOUND' ELSE home END AS department_url,
  CASE WHEN segment = 'AUTOMOBILE' THEN concat('dept_', lower(c_name))
       ELSE concat('dept_d', c_custkey, 'b', block) END AS department_id
  FROM d1 WHERE college IS NOT NULL)"""
_SITE_BOARDS = f"""{_SITE},
prio AS (SELECT DISTINCT home, o_orderpriority AS p FROM o),
site AS (SELECT DISTINCT home FROM o WHERE o_orderstatus = 'F'),
raw_boards AS (
SELECT home, 0 AS src, substr(p, 1, 1)::INT AS pos, CASE p WHEN '1-URGENT' THEN 'scholarship'
  WHEN '3-MEDIUM' THEN 'career' ELSE 'notice' END AS base, CASE p WHEN '1-URGENT' THEN '장학공지'
  WHEN '2-HIGH' THEN '공지사항' WHEN '3-MEDIUM' THEN '취업 정보' ELSE '알림' END AS board_name,
  concat('board/', substr(p, 1, 1)) AS path FROM prio WHERE p <> '4-NOT SPECIFIED'
UNION ALL SELECT home, 1, 0, 'notice', '공지 모음', 'extra' FROM site
UNION ALL SELECT home, 1, 1, 'notice', '공지 둘', 'extra2' FROM site
UNION ALL SELECT home, 1, 2, 'notice', '공지 셋', 'board/2' FROM site),
numbered AS (SELECT *, row_number() OVER (PARTITION BY home, src, base ORDER BY pos) AS k FROM raw_boards),
merged AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY home, path ORDER BY src, pos) = 1),
board AS (SELECT dep.*, board_name, CASE WHEN k > 1 THEN concat(base, '_', k) ELSE base END AS board_id,
  concat(home, path, CASE WHEN path = 'board/1' AND segment <> 'BUILDING' THEN '.do' ELSE '' END) AS board_url,
  path, CASE WHEN path LIKE 'board/%' AND (home, substr(path, 7, 1)) IN (SELECT (home, substr(p, 1, 1)) FROM prio)
        THEN 1 ELSE 0 END AS has_page
  FROM merged JOIN dep USING (home) WHERE department_url <> 'NOT_FOUND')"""
_SITE_ROWS = f"""{_SITE_BOARDS},
listed AS (SELECT board.*, o_orderkey, o_orderstatus, o_orderpriority, raw_date,
  '' AS raw_title, concat(home, 'view/', o_orderkey) AS link, CAST(o_orderkey AS VARCHAR) AS source_id
  FROM board JOIN o USING (home) WHERE path LIKE 'board/%' AND substr(path, 7, 1) = substr(o_orderpriority, 1, 1)),
good_rows AS (SELECT * FROM listed WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW'))"""
ORACLES["q18_heading_segments"] = f"""WITH {_SITE}
SELECT campus, college, department_name AS department, department_url AS url FROM dep"""
ORACLES["q28_map_departments"] = f"""WITH {_SITE}
SELECT campus, college, department_id, department_name, department_url FROM dep"""
ORACLES["q28b_map_boards"] = f"""WITH {_SITE_BOARDS}
SELECT campus, college, department_id, board_id, board_name, board_url,
  CASE WHEN segment = 'BUILDING' THEN 'table.bl_list tr:has(td.td-subject)'
       WHEN has_page = 1 AND path = 'board/1' THEN 'tr:has(a.c-board-title)'
       WHEN has_page = 1 AND path = 'board/2' THEN
         'li.xe-list-board-list--item:not(.xe-list-board-list--header)'
       ELSE 'table tr:has(a)' END AS row_selector FROM board"""
ORACLES["q28c_map_reviews"] = f"""WITH {_SITE_BOARDS}
SELECT campus, department_name AS name, department_url AS url,
  CASE WHEN department_url = 'NOT_FOUND' THEN 'Homepage URL is invalid'
       ELSE 'No boards discovered from homepage or sitemap' END AS reason FROM dep
WHERE department_url = 'NOT_FOUND' OR home NOT IN (SELECT home FROM board)"""
ORACLES["q28d_crawl_notices"] = f"""WITH {_SITE_ROWS}, {_dated('good_rows', 'g')}
SELECT campus, college, department_id, department_name, board_id, board_name,
  concat(o_orderstatus, ' & notice ', o_orderkey) AS title, raw_date AS date, link, source_id, id, notice_key
FROM g"""
ORACLES["q28g_repeated_pages"] = ORACLES["q28d_crawl_notices"]
_OUTCOME = f"""{_SITE_ROWS}, totals AS (SELECT (SELECT count(*) FROM board) AS board_total,
  (SELECT count(*) FROM board WHERE has_page = 0) AS board_failures,
  (SELECT count(*) FROM listed) AS notice_total,
  (SELECT count(*) FROM listed) - (SELECT count(*) FROM good_rows) AS notice_failures,
  (SELECT count(*) FROM good_rows) AS detail_total, 0::BIGINT AS detail_failures)"""
ORACLES["q28e_crawl_outcome"] = f"""WITH {_OUTCOME}
SELECT *, (board_total - board_failures) / board_total::DOUBLE AS board_success_rate,
  (notice_total - notice_failures) / notice_total::DOUBLE AS notice_success_rate,
  1.0::DOUBLE AS detail_success_rate FROM totals"""
ORACLES["q21d_stored_errors"] = f"""WITH {_SITE_BOARDS}
SELECT CASE WHEN segment = 'BUILDING' THEN 'selector' ELSE 'board_list' END AS stage, board_id, board_name,
  board_url AS url, CASE WHEN segment = 'BUILDING' THEN 'unsupported selector: tr:hover'
    ELSE 'page not available' END AS message, false AS retryable
FROM board WHERE segment = 'BUILDING' OR has_page = 0"""
ORACLES["q28h_missing_links"] = f"""WITH {_SITE_ROWS}
SELECT campus, college, department_id, board_id, count(*) AS row_total,
  count(*) FILTER (o_orderkey % 10 = 5) AS link_missing FROM listed
GROUP BY campus, college, department_id, board_id, board_url HAVING count(*) FILTER (o_orderkey % 10 = 5) > 0"""
ORACLES["q28f_full_run"] = f"""WITH {_OUTCOME}, counts AS (
SELECT *, (SELECT count(DISTINCT (campus, college, department_name)) FROM dep) AS department_count FROM totals)
SELECT run_id, status, detail_total AS current_count, CASE WHEN run_id = 'r1' THEN detail_total ELSE 0 END AS added,
  0::BIGINT AS updated, 0::BIGINT AS removed, department_count, board_total AS board_count, notice_total
FROM counts, (VALUES ('r1', 'cold_start'), ('r2', 'safe')) AS r(run_id, status)"""

ORACLES["q25_stream_new_notices"] = "SELECT DISTINCT user_id, event_type FROM events"
_STREAM = """stream AS (SELECT 'stream' AS campus, o_orderstatus AS department_id, o_orderpriority AS board_id,
  concat(' a  notice ', o_orderkey) AS raw_title, strftime(o_orderdate, '%y.%-m.%-d') AS raw_date,
  concat('https://example.com/list?seq=', o_orderkey) AS link, CAST(o_orderkey AS VARCHAR) AS source_id
  FROM orders)"""
ORACLES["q25b_stream_normalize"] = f"""WITH {_STREAM}, {_dated('stream', 's')}
SELECT title, date, source_id, id, notice_key FROM s"""
ORACLES["q25e_exact_feed"] = """SELECT concat_ws(':', user_id, event_type, CAST(floor(value) AS BIGINT)) AS key,
  min(event_id % 3)::BIGINT AS batch FROM events GROUP BY ALL"""
ORACLES["q25c_stream_commit"] = f"""{_RUNS}
SELECT 0::BIGINT AS seq, 'cold_start' AS status, count(*) AS current_count, 0::BIGINT AS previous_count,
       count(*) AS added, 0::BIGINT AS updated, 0::BIGINT AS removed FROM before_
UNION ALL SELECT 1, 'safe', (SELECT count(*) FROM now_), (SELECT count(*) FROM before_),
  (SELECT count(*) FROM now_ WHERE notice_key NOT IN (SELECT notice_key FROM before_)),
  (SELECT count(*) FROM now_ w JOIN before_ b USING (notice_key) WHERE w.title <> b.title),
  (SELECT count(*) FROM before_ WHERE notice_key NOT IN (SELECT notice_key FROM now_))"""
ORACLES["q26d_selector_forms"] = ORACLES["q26_extract_rows"]
# Rows of the first run are all archived by the second: its own cold ones, and those of its month.
ORACLES["q27c_rollover"] = f"""{_RUNS}, dated AS (
SELECT notice_key, title, 0 AS o, day, CAST(coalesce(year(day), 2000) AS BIGINT) AS year,
       CAST(coalesce(month(day), 12) AS BIGINT) AS month FROM before_
UNION ALL SELECT notice_key, title, 1, day, CAST(coalesce(year(day), 2001) AS BIGINT), CAST(coalesce(month(day), 7) AS BIGINT)
FROM now_)
SELECT notice_key, title, year, month FROM dated
WHERE (o = 0 AND NOT (year = 2000 AND month = 12)) OR (o = 1 AND NOT (year = 2001 AND month = 7))
   OR (o = 0 AND notice_key NOT IN (SELECT notice_key FROM now_))
QUALIFY row_number() OVER (PARTITION BY notice_key, year, month ORDER BY o) = 1"""
ORACLES["q14e_resolve_pages"] = """WITH p AS (
SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
       regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS folder FROM pages),
b AS (SELECT page_id, scheme || '://User:pw@' || lower(host) AS origin,
             CASE WHEN folder = '' THEN '/' ELSE folder END AS folder FROM p)
SELECT page_id, 0 AS form, origin || '/c/d' || page_id AS link FROM b
UNION ALL SELECT page_id, 1, origin || folder || 'x?q={' || page_id || '}%27' FROM b
UNION ALL SELECT page_id, 2, origin || folder || 'y' || page_id FROM b
UNION ALL SELECT page_id, 3, origin || folder || '%7Ba%7D%60#{b}%60' FROM b"""
