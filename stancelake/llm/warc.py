"""Not-modified revisit resolution: as-of join by canonical URL.

A capture is a full response (status 200) or a revisit (status 304).  A revisit
is resolved to the latest earlier full response of the same canonical URL, its
validators are checked against that response's, and the headers a 304 may
update are merged into the stored ones.

The as-of join is a last-value scan over (URL, time), done in two levels so
that no URL has to fit one task: captures are range-partitioned by (URL, time,
id), which splits a hot URL over many chunks; a window inside (chunk, URL)
finds the response within the chunk; the last response of each (URL, chunk) is
carried to the URL's later chunks, at most one row per chunk and URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# Header fields that describe the stored body or the connection; a 304 does not update them.
NOT_UPDATED = ["connection", "content-encoding", "content-length", "content-range", "content-type",
               "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
               "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Key of a URL: no scheme, fragment, ``www.``, default port or final slash; host in lower case; parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last in order of bytes is kept; null: no headers."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value"))))
    last = F.filter(pairs, lambda e, i: (i == F.size(pairs) - 1) | (F.get(pairs, i + 1).key != e.key))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit of ``captures(record_id long, url string, ts timestamp or long, status int, headers map)``.

    Returns record_id, canonical_url, original_id, outcome, headers (merged,
    names in lower case).  Outcomes: ``resolved`` (entity tags equal by weak
    comparison, or, where one side has none, last-modified equal),
    ``mismatch`` (the validators differ), ``unverified`` (no validator on both
    sides), ``no_original`` (no earlier full response), ``no_key`` (null URL or
    time).  Only resolved rows carry merged headers; the others keep the
    revisit's own.  A response at the revisit's own time is not earlier; among
    responses at the same time the larger record_id wins.  Repeated rows give
    repeated results.  Statuses other than 200 and 304 and null statuses take no
    part.  An empty table gives an empty result; other columns are ignored.
    """
    c = captures.filter(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts",
        (F.col("status") == 200).alias("full"), _lower_keys(F.col("headers")).alias("headers"))
    keyed = c.filter("canonical_url is not null and ts is not null")
    order = ["canonical_url", "ts", "full", "record_id"]
    chunks = staged(keyed.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), "warc-chunks")

    whole = F.when(F.col("full"), F.struct("record_id", "headers"))
    inside = Window.partitionBy("chunk", "canonical_url").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = chunks.withColumn("original", F.last(whole, ignorenulls=True).over(inside)).filter(~F.col("full"))

    ends = (chunks.filter("full").groupBy("canonical_url", "chunk")
            .agg(F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("own")))
    places = chunks.filter(~F.col("full")).select("canonical_url", "chunk").distinct()
    earlier = Window.partitionBy("canonical_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (places.join(ends, ["canonical_url", "chunk"], "full")
               .withColumn("carried", F.last("own", ignorenulls=True).over(earlier))
               .select("canonical_url", "chunk", "carried"))
    found = (found.join(carried, ["canonical_url", "chunk"], "left")
             .withColumn("original", F.coalesce("original", "carried")))

    tag, stored_tag = _weak(F.col("headers")["etag"]), _weak(F.col("original.headers")["etag"])
    when, stored_when = F.col("headers")["last-modified"], F.col("original.headers")["last-modified"]
    both_tags, both_times = tag.isNotNull() & stored_tag.isNotNull(), when.isNotNull() & stored_when.isNotNull()
    outcome = (F.when(F.col("original").isNull(), "no_original")
               .when(both_tags, F.when(tag == stored_tag, "resolved").otherwise("mismatch"))
               .when(both_times, F.when(when == stored_when, "resolved").otherwise("mismatch"))
               .otherwise("unverified"))
    update = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_UPDATED) & v.isNotNull())
    stored = F.map_filter("original.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    resolved = found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", F.col("original.record_id").alias("original_id"), "outcome",
        F.when(F.col("outcome") == "resolved", F.map_concat(stored, update)).otherwise(F.col("headers")).alias("headers"))
    unkeyed = c.filter("not full and (canonical_url is null or ts is null)").select(
        "record_id", "canonical_url", F.lit(None).cast("long").alias("original_id"), F.lit("no_key").alias("outcome"), "headers")
    return resolved.unionByName(unkeyed)
