"""Stand-in crawl captures derived from the driver's ``pages`` and ``part`` tables.

The driver tables hold raw HTML pages without JSON-LD.  The templates below
only *shape* them into the inputs our jobs expect (captured HTTP responses,
scans, DNS answers, robots and sitemap documents, scan requests); they do none
of the jobs' work.  Each template is plain SQL accepted by both Spark and
DuckDB, so the Spark job and its DuckDB oracle read identical inputs.

Placeholders: ``{pages}`` and ``{part}`` name the driver tables; literal
braces are doubled.  In Spark the placeholders are bound to DataFrames with
``spark.sql(template, pages=df, part=df)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from crawlscope.session import configure
from crawlscope.sources.tables import load

# Origin (scheme://authority) of a page URL as written in the driver table.
_ORIGIN = "regexp_extract({t}.url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"

# JSON-LD injected before </head>, chosen by page_id % 8 (and % 16 for
# variants).  Keys are in no order, numbers in spellings that a parser would
# rewrite, and some names hold dots and quotes.
_INJECT = """
CASE p.page_id % 8
  WHEN 1 THEN CASE WHEN p.page_id % 16 = 1
    THEN '<script type="application/ld+json">{{"sku":"' || CAST(p.page_id AS STRING) || '","name":"' || q.p_name || '", "@type" : "Product","weight":1.0,"brand":"' || q.p_brand || '","@context":{{"url":"x", "@vocab":"https://schema.org/"}},"offers":[{{"price":"","@type":"Offer"}},7,{{"availability":"InStock","price":1e2}}]}}</script>'
    ELSE '<SCRIPT type=''application/ld+json''>{{"name":"' || q.p_name || '","gtin":12345678901234567890123,"sku":"' || CAST(p.page_id AS STRING) || '","a.b":1e2,"q' || chr(92) || '"t":[],"@type":"Product","offers":{{"price":' || CAST(q.p_size AS STRING) || '.50}},"image":" ","@context":"https://schema.org"}}</SCRIPT>' END
  WHEN 2 THEN '<script type="application/ld+json">[{{"name":"' || q.p_name || '","@type":"WebPage","@context":"https://schema.org"}},"plain",{{"@graph":[{{"name":"' || q.p_name || '","@type":"Product"}},{{"price":"' || CAST(q.p_size AS STRING) || '","@type":["Offer",7]}}],"@context":"https://schema.org"}}]</script>'
  WHEN 3 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Product","name":"' || q.p_name || '"' || chr(10) || '```' || chr(10) || ',"x" | y</script>'
  WHEN 4 THEN '<script type="application/ld+json">{{"@type":"Organization","name":"' || q.p_brand || '"}}</script><script type="application/ld+json">{{"@type":</script>'
  WHEN 5 THEN '<script type="application/json">{{"@type":"Thing"}}</script>'
  WHEN 6 THEN '<!-- <script type="application/ld+json">{{"@type":"Thing"}}</script> -->'
  WHEN 7 THEN '<script type="application/ld+json">{{"@type":"Thing","name":"' || q.p_name || '"}} trailing</script>'
  ELSE '' END
"""

# Captured responses: one row per requested URL.  Pages with page_id % 11 = 7
# answer 302: even ids move to a captured same-origin /moved/<id> URL, odd ids
# point at another page's URL, ids divisible by 7 point at themselves.  Some
# URLs were captured again: before their request (a failure) or after it.
RESPONSES_SQL = """
WITH src AS (
  SELECT p.page_id, p.url, """ + _ORIGIN.format(t="p") + """ AS origin,
         replace(p.html, '</head>', """ + _INJECT + """ || '</head>') AS body
  FROM {pages} p LEFT JOIN {part} q ON q.p_partkey = p.page_id
),
base AS (
  SELECT s.origin AS scan_id, s.page_id, s.url, s.page_id * 2 AS seq,
         CASE WHEN s.page_id % 11 = 3 THEN 404 WHEN s.page_id % 11 = 7 THEN 302
              WHEN s.page_id % 11 = 9 THEN 500 ELSE 200 END AS http_status,
         CASE WHEN s.page_id % 13 = 5 THEN 'application/pdf'
              WHEN s.page_id % 2 = 0 THEN ' Text/HTML; charset=UTF-8'
              WHEN s.page_id % 19 = 1 THEN NULL
              ELSE 'text/html' END AS content_type,
         CASE WHEN s.page_id % 17 = 4 THEN 'unknown' WHEN s.page_id % 17 = 9 THEN NULL
              WHEN s.page_id % 29 = 3 THEN '90000000'
              ELSE CAST(length(s.body) AS STRING) END AS content_length,
         CASE WHEN s.page_id % 11 <> 7 THEN NULL
              WHEN s.page_id % 7 = 0 THEN s.url
              WHEN s.page_id % 2 = 0 THEN '/moved/' || CAST(s.page_id AS STRING)
              ELSE o.url END AS location,
         CASE WHEN s.page_id % 11 = 7 THEN '' ELSE s.body END AS body,
         CASE WHEN s.page_id % 23 = 6 AND s.page_id % 11 <> 7 THEN 'Request timed out' END AS error,
         CAST((s.page_id * 37) % 1000 AS INT) AS duration_ms
  FROM src s LEFT JOIN {pages} o ON o.page_id = s.page_id - 7
),
moved AS (
  SELECT s.origin AS scan_id, s.page_id, s.origin || '/moved/' || CAST(s.page_id AS STRING) AS url,
         s.page_id * 2 AS seq, 200 AS http_status, 'text/html' AS content_type,
         CAST(NULL AS STRING) AS content_length, CAST(NULL AS STRING) AS location,
         s.body, CAST(NULL AS STRING) AS error, CAST((s.page_id * 41) % 1000 AS INT) AS duration_ms
  FROM src s WHERE s.page_id % 11 = 7 AND s.page_id % 2 = 0 AND s.page_id % 7 <> 0
),
again AS (
  SELECT s.origin AS scan_id, s.page_id, s.url, s.page_id * 2 + v.later AS seq, v.status AS http_status, 'text/html' AS content_type,
         CAST(NULL AS STRING) AS content_length, CAST(NULL AS STRING) AS location, v.text AS body, CAST(NULL AS STRING) AS error,
         CAST(s.page_id % 100 AS INT) AS duration_ms
  FROM src s CROSS JOIN (VALUES (-1, 503, '', 2), (10, 200, '<script type="application/ld+json">{{"@type":"Later"}}</script>', 2),
                                (10, 200, '<p>later</p>', 6)) AS v(later, status, text, rest)
  WHERE s.page_id % 12 = v.rest
)
SELECT * FROM base UNION ALL SELECT * FROM moved UNION ALL SELECT * FROM again
"""

# The URL list of each scan: every driver page, in page order.
PAGE_REQUESTS_SQL = """
SELECT """ + _ORIGIN.format(t="p") + """ AS scan_id, p.url, p.page_id * 2 AS seq,
       CAST(NULL AS STRING) AS sitemap_source
FROM {pages} p
"""

# URLs as listed by sitemaps, in discovery order: each page, a fragment
# variant, a private URL for every fifth page and a foreign-origin URL for
# every seventh.
DISCOVERED_SQL = """
SELECT """ + _ORIGIN.format(t="p") + """ AS scan_id, p.url,
       """ + _ORIGIN.format(t="p") + """ || '/sitemaps/part-' || CAST(p.page_id % 4 AS STRING) || '.xml' AS source,
       p.page_id * 4 AS seq
FROM {pages} p
UNION ALL
SELECT """ + _ORIGIN.format(t="p") + """, p.url || '#again', """ + _ORIGIN.format(t="p") + """ || '/sitemap_index.xml',
       p.page_id * 4 + 1 FROM {pages} p
UNION ALL
SELECT """ + _ORIGIN.format(t="p") + """, 'http://localhost/' || CAST(p.page_id AS STRING), 'robots', p.page_id * 4 + 2
FROM {pages} p WHERE p.page_id % 5 = 0
UNION ALL
SELECT """ + _ORIGIN.format(t="p") + """, 'https://elsewhere.example.com/' || CAST(p.page_id AS STRING), 'robots',
       p.page_id * 4 + 3 FROM {pages} p WHERE p.page_id % 7 = 0
"""

# Scan lifecycle control events per origin (seq orders them): every scan
# starts and lists its URLs; most complete; some are cancelled (some of those
# before completing, some after), a few fail, some are still crawling.
CONTROL_EVENTS_SQL = """
WITH o AS (SELECT """ + _ORIGIN.format(t="p") + """ AS scan_id, min(p.page_id) AS m FROM {pages} p GROUP BY 1)
SELECT scan_id, 'started' AS type, 1 AS seq, CAST(NULL AS STRING) AS message FROM o
UNION ALL SELECT scan_id, 'urls_listed', 2, NULL FROM o WHERE m % 9 <> 4
UNION ALL SELECT scan_id, 'completed', 10, NULL FROM o WHERE m % 6 <> 2 AND m % 9 <> 4
UNION ALL SELECT scan_id, 'cancel', CASE WHEN m % 2 = 0 THEN 5 ELSE 12 END, NULL FROM o WHERE m % 5 = 1
UNION ALL SELECT scan_id, 'error', 11, 'Storage write failed for ' || scan_id FROM o WHERE m % 11 = 3
"""

# One scan per origin; settings vary with the origin so caps, byte limits,
# redirect limits and the same-origin flag are all exercised.
SCANS_SQL = """
SELECT origin AS scan_id, origin || '/' AS target_url,
       CASE WHEN length(origin) % 6 = 1 THEN origin || '/sitemaps/part-1.xml' END AS sitemap_url,
       CASE WHEN length(origin) % 4 = 0 THEN 3 ELSE 500 END AS max_urls,
       4 AS concurrency, 250 AS delay_ms, 15000 AS timeout_ms,
       CASE WHEN length(origin) % 10 = 3 THEN 700 WHEN length(origin) % 5 = 0 THEN 9000
            ELSE 5000000 END AS max_response_bytes,
       CASE WHEN length(origin) % 3 = 0 THEN 1 ELSE 5 END AS max_redirects,
       true AS respect_robots,
       length(origin) % 7 <> 0 AS same_origin_only,
       15 AS as_of,
       CAST(1767225600000 + min_id * 1000 AS BIGINT) AS created_ms
FROM (SELECT """ + _ORIGIN.format(t="p") + """ AS origin, min(p.page_id) AS min_id
      FROM {pages} p GROUP BY 1) o
"""

# What each host resolved to at capture time.  Some hosts resolve to a
# private address, some to a public and a private one, some are missing.
DNS_SQL = """
WITH h AS (
  SELECT DISTINCT regexp_extract(p.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host FROM {pages} p
)
SELECT host, CASE WHEN length(host) % 9 = 4 THEN '10.1.2.' ELSE '203.0.113.' END
             || CAST(length(host) AS STRING) AS address
FROM h WHERE length(host) % 9 NOT IN (2, 7)
UNION ALL
SELECT host, CAST(NULL AS STRING) AS address FROM h WHERE length(host) % 9 = 7
UNION ALL
SELECT host, '192.168.7.' || CAST(length(host) AS STRING) AS address FROM h WHERE length(host) % 9 = 6
"""

# robots.txt per origin, built from the origin's own paths.
ROBOTS_SQL = """
SELECT origin AS scan_id, origin || '/robots.txt' AS url,
       CASE WHEN length(origin) % 8 = 5 THEN 503 ELSE 200 END AS http_status,
       '# robots for ' || origin || chr(10) ||
       'User-agent: *' || chr(10) ||
       'Disallow: /' || min_lang || '/' || chr(10) ||
       'Allow: /' || min_lang || '/' || CAST(min_id % 10 AS STRING) || chr(10) ||
       chr(10) ||
       'User-agent: crawlscope' || chr(10) ||
       'User-agent: markup-probe' || chr(13) || chr(10) ||
       'Disallow: /' || max_lang || '/' || CAST(max_id % 10 AS STRING) || '  # private' || chr(10) ||
       'Crawl-delay: 5' || chr(10) ||
       'User-agent: other-bot' || chr(10) ||
       'Disallow: /' || chr(10) ||
       'Sitemap: ' || origin || '/sitemap_index.xml' || chr(10) ||
       'Sitemap: ' || origin || '/sitemap_index.xml' || chr(10) ||
       'Sitemap:' || chr(10) AS body
FROM (SELECT """ + _ORIGIN.format(t="p") + """ AS origin,
             min(regexp_extract(p.url, '^[a-zA-Z]+://[^/]*/([a-z]+)', 1)) AS min_lang,
             max(regexp_extract(p.url, '^[a-zA-Z]+://[^/]*/([a-z]+)', 1)) AS max_lang,
             min(p.page_id) AS min_id, max(p.page_id) AS max_id
      FROM {pages} p GROUP BY 1) o
"""

# Sitemap documents per origin: an index listing chunk sitemaps (page_id % 4
# within blocks of 40,000 ids, so one document never lists over 10,000 URLs),
# itself (a cycle), a fragment duplicate and a private URL; chunk 3 is
# truncated XML for some origins; /sitemap.xml answers 404 or points at the
# index; further listed documents point to another origin, at themselves or
# nowhere.  Chunks were captured before and after the scan (``as_of``), too.
# Locations are written with XML escaping (&amp;).
SITEMAPS_SQL = """
WITH u AS (
  SELECT """ + _ORIGIN.format(t="p") + """ AS origin, p.page_id, p.url,
         p.page_id % 4 + 4 * CAST(floor(p.page_id / 40000) AS BIGINT) AS chunk FROM {pages} p
),
chunks AS (
  SELECT origin, chunk,
         string_agg('<url><loc>' || replace(url, '&', '&amp;') || '</loc><priority>0.5</priority></url>', ''<<ORDER BY page_id>>) AS entries,
         min(page_id) AS min_id
  FROM u GROUP BY origin, chunk
),
idx AS (
  SELECT origin,
         string_agg('<sitemap><loc>' || origin || '/sitemaps/part-' || CAST(chunk AS STRING) || '.xml</loc></sitemap>', ''<<ORDER BY chunk>>) AS entries
  FROM chunks GROUP BY origin
)
SELECT origin AS scan_id, origin || '/sitemap_index.xml' AS url, 200 AS http_status,
       CAST(NULL AS STRING) AS location, 10 AS seq,
       '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) ||
       '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || entries ||
       '<sitemap><loc>' || origin || '/sitemap_index.xml</loc></sitemap>' ||
       '<sitemap><loc>' || origin || '/sitemaps/part-0.xml#again</loc></sitemap>' ||
       '<sitemap><loc>http://127.0.0.1/sitemap.xml</loc></sitemap>' ||
       '<sitemap><loc>' || origin || '/sitemaps/away.xml</loc></sitemap>' ||
       '<sitemap><loc>' || origin || '/sitemaps/loop.xml</loc></sitemap>' ||
       '<sitemap><loc>' || origin || '/sitemaps/nowhere.xml</loc></sitemap>' ||
       '<sitemap><loc>' || origin || '/sitemaps/twice.xml</loc></sitemap>' ||
       '</sitemapindex>' AS body
FROM idx
UNION ALL
SELECT origin, origin || '/sitemaps/part-' || CAST(chunk AS STRING) || '.xml', 200, CAST(NULL AS STRING), 10,
       CASE WHEN chunk = 3 AND length(origin) % 2 = 0
            THEN '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || entries
            ELSE '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) ||
                 '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || entries ||
                 '<url><loc>http://localhost/admin</loc></url></urlset>' END
FROM chunks
UNION ALL
SELECT origin, origin || '/sitemap.xml', CASE WHEN length(origin) % 5 = 1 THEN 302 ELSE 404 END,
       CASE WHEN length(origin) % 5 = 1 THEN '/sitemap_index.xml' END, 10, '' FROM idx
UNION ALL
SELECT origin, origin || '/sitemaps/part-' || CAST(chunk AS STRING) || '.xml', v.status, CAST(NULL AS STRING), v.seq, '<urlset></urlset>'
FROM chunks CROSS JOIN (VALUES (503, 5), (200, 20)) AS v(status, seq) WHERE chunk % 2 = 1
UNION ALL
SELECT origin, origin || '/sitemaps/' || v.name, 301, CASE WHEN v.target LIKE '/%' THEN origin || v.target ELSE v.target END, 10, ''
FROM idx CROSS JOIN (VALUES ('away.xml', 'https://elsewhere.example.com/s.xml'), ('loop.xml', '/sitemaps/loop.xml'), ('nowhere.xml', NULL),
                            ('twice.xml', '/sitemaps/once.xml'), ('once.xml', '/sitemaps/gone.xml')) AS v(name, target)
"""

# Raw scan requests (target text + settings JSON text) for request validation
# and settings normalisation.
REQUESTS_SQL = """
SELECT p.page_id AS request_id,
       CASE p.page_id % 6 WHEN 1 THEN 'ftp://' || substr(p.url, 9)
                          WHEN 2 THEN 'https://user:pw@' || substr(p.url, 9)
                          WHEN 3 THEN 'http://localhost:8080/' || CAST(p.page_id AS STRING)
                          WHEN 4 THEN 'not a url ' || CAST(p.page_id AS STRING)
                          ELSE p.url END AS target_url,
       CASE WHEN p.page_id % 5 = 0 THEN regexp_extract(p.url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/sitemap.xml'
            WHEN p.page_id % 5 = 1 THEN 'http://10.0.0.' || CAST(p.page_id % 250 AS STRING) || '/sitemap.xml'
            ELSE NULL END AS sitemap_url,
       CASE p.page_id % 7
         WHEN 0 THEN '{{"maxUrls":' || CAST(p.page_id % 700 AS STRING) || ',"concurrency":2.5,"delayMs":"fast","respectRobots":false}}'
         WHEN 1 THEN '{{"maxUrls":-3,"concurrency":16,"timeoutMs":999,"maxRedirects":10,"sameOriginOnly":"no"}}'
         WHEN 2 THEN '[1,2]'
         WHEN 3 THEN '{{"maxResponseBytes":' || CAST(1000 + p.page_id AS STRING) || ',"maxRedirects":3.5,"delayMs":-2.5,"respectRobots":null}}'
         WHEN 4 THEN NULL
         WHEN 5 THEN '{{"maxUrls":1e2,"concurrency":"4","sameOriginOnly":false,"timeoutMs":120000.4}}'
         ELSE '{{"maxUrls":499.5,"maxRedirects":0,"delayMs":60000}}' END AS settings_json
FROM {pages} p
"""


_ORDERED = re.compile(r"<<(ORDER BY [^>]*)>>\)")


def dialect(sql: str, engine: str) -> str:
    """Render ordered string aggregation for ``engine`` ('spark' or 'duckdb')."""
    if engine == "spark":
        return _ORDERED.sub(r") WITHIN GROUP (\1)", sql)
    return _ORDERED.sub(r" \1)", sql)


def _bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    configure(spark)
    return spark.sql(dialect(sql, "spark"), pages=load(spark, sf_dir, "pages"), part=load(spark, sf_dir, "part"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, RESPONSES_SQL)


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, PAGE_REQUESTS_SQL)


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, DISCOVERED_SQL)


def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, CONTROL_EVENTS_SQL)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, SCANS_SQL)


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, DNS_SQL)


def robots_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, ROBOTS_SQL)


def sitemap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, SITEMAPS_SQL)


def scan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, REQUESTS_SQL)


def duckdb_cte(recursive: bool = False) -> str:
    """The same inputs as DuckDB common table expressions (for oracles)."""
    parts = {
        "responses": RESPONSES_SQL, "page_requests": PAGE_REQUESTS_SQL, "discovered": DISCOVERED_SQL, "control_events": CONTROL_EVENTS_SQL, "scans": SCANS_SQL, "dns": DNS_SQL,
        "robots_docs": ROBOTS_SQL, "sitemap_docs": SITEMAPS_SQL, "scan_requests": REQUESTS_SQL,
    }
    body = ",\n".join(f"{name} AS ({dialect(sql, 'duckdb').format(pages='pages', part='part')})"
                      for name, sql in parts.items())
    return ("WITH RECURSIVE " if recursive else "WITH ") + body + ",\n"
