"""Query of the revisit resolution.

``pages`` holds one page per row; the crawl log derived from it has, for each
page, two full responses and two revisits (for one page in 17 early ones),
with validators that agree with one response or the other, differ or are missing by page.  A third of all
captures is of one URL, so the latest earlier response is one of many and the URL spans chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .warc import resolve_revisits

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, k, page_id * 37 + k * 4000 AS ts, '"' || substr(md5(html), 1 + 16 * k, 16) || '"' AS tag, length(html)::VARCHAR AS size,
         regexp_replace(trim(CASE WHEN page_id % 3 = 0 THEN 'https://WWW.hot.example.com:443/start/?b=2&a=1#top' ELSE url END), '#.*$', '') AS u0
  FROM pages, (SELECT unnest([0, 1]) AS k) WHERE page_id IS NOT NULL),
n AS (SELECT *, regexp_replace(u0, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM p),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')), '&') AS par FROM n),
c AS (SELECT *, host || path || CASE WHEN par <> '' THEN '?' || par ELSE '' END AS canonical_url FROM q),
f AS (
  SELECT 10 * page_id + k AS record_id, canonical_url, ts, CASE WHEN page_id % 5 <> 0 THEN tag END AS etag,
         CASE WHEN page_id % 7 <> 0 THEN 'm' || page_id || '-' || k END AS lm, size FROM c),
r AS (
  SELECT 10 * page_id + 5 + k AS record_id, page_id, canonical_url,
         CASE WHEN page_id % 17 = 0 THEN ts - 10 ELSE ts + 1 + (page_id % 11) * 1000 END AS ts,
         CASE WHEN page_id % 13 = 0 THEN '"changed"' WHEN page_id % 3 <> 0 THEN 'W/' || tag END AS etag,
         CASE WHEN page_id % 7 <> 0 THEN 'm' || page_id || '-' || k END AS lm FROM c),
a AS (
  SELECT r.*, (SELECT max(struct_pack(ts := f.ts, record_id := f.record_id, etag := f.etag, lm := f.lm, size := f.size))
               FROM f WHERE f.canonical_url = r.canonical_url AND f.ts < r.ts) AS o
  FROM r),
s AS (
  SELECT *, CASE WHEN o IS NULL AND canonical_url IS NULL THEN 'no_key' WHEN o IS NULL THEN 'no_original'
              WHEN etag IS NOT NULL AND o.etag IS NOT NULL
                THEN CASE WHEN regexp_replace(etag, '^W/', '') = o.etag THEN 'resolved' ELSE 'mismatch' END
              WHEN lm IS NOT NULL AND o.lm IS NOT NULL
                THEN CASE WHEN lm = o.lm THEN 'resolved' ELSE 'mismatch' END
              ELSE 'unverified' END AS outcome FROM a)
SELECT record_id, canonical_url, o.record_id AS original_id, outcome,
       array_to_string([x for x in [
         'cache-control: max-age=' || '120',
         CASE WHEN outcome = 'resolved' THEN 'content-length: ' || o.size ELSE 'content-length: 0' END,
         CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' END,
         'date: ' || ts,
         'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, o.etag) ELSE etag END,
         'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(lm, o.lm) ELSE lm END] if x IS NOT NULL], chr(10)) AS headers
FROM s
"""


HOT_URL = "https://WWW.hot.example.com:443/start/?b=2&a=1#top"


def crawl_log(pages):
    """Captures (record_id, url, ts, status, headers) derived from ``pages``."""
    p = pages.filter("page_id is not null").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, F.lit(HOT_URL)).otherwise(F.col("url")).alias("url"),
        F.md5("html").alias("mark"), F.length("html").cast("string").alias("size"))

    def headers(*pairs):
        given = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
        return F.map_from_entries(F.filter(given, lambda e: e.value.isNotNull()))

    captures = []
    for k in (0, 1):
        at = F.col("page_id") * 37 + k * 4000
        tag = F.concat(F.lit('"'), F.substring("mark", 1 + 16 * k, 16), F.lit('"'))
        known = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("m"), F.col("page_id"), F.lit(f"-{k}")))
        later = F.when(F.col("page_id") % 17 == 0, at - 10).otherwise(at + 1 + F.col("page_id") % 11 * 1000)
        captures.append(F.struct((F.col("page_id") * 10 + k).alias("record_id"), at.alias("ts"), F.lit(200).alias("status"), headers(
            ("Content-Type", F.lit("text/html")), ("Content-Length", F.col("size")), ("Cache-Control", F.lit("max-age=60")),
            ("Date", at), ("ETag", F.when(F.col("page_id") % 5 != 0, tag)), ("Last-Modified", known)).alias("headers")))
        captures.append(F.struct((F.col("page_id") * 10 + 5 + k).alias("record_id"), later.alias("ts"), F.lit(304).alias("status"), headers(
            ("content-length", F.lit("0")), ("cache-control", F.lit("max-age=120")), ("date", later),
            ("etag", F.when(F.col("page_id") % 13 == 0, F.lit('"changed"')).when(F.col("page_id") % 3 != 0, F.concat(F.lit("W/"), tag))),
            ("last-modified", known)).alias("headers")))
    return p.select("url", F.inline(F.array(*captures)))


@query("op1_warc_revisits", WARC_SQL)
def warc_revisits(spark, sf_dir):
    """Every revisit of the crawl log derived from ``pages``; headers as sorted lines."""
    out = resolve_revisits(crawl_log(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e.key, e.value))
    return out.withColumn("headers", F.array_join(F.array_sort(lines), "\n"))
