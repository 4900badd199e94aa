"""Query of the source mixing."""

from __future__ import annotations

from .mixing import mix_to_weights
from .registry import query, table

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(text))), 1, 13))::BIGINT AS h
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM p),
f AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before
  FROM w
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap <= weight * ((total - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE) AS capped FROM f),
r AS (
  SELECT *, all_weight - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS rest_weight,
         total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS rest_total FROM g),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE rest_total::DOUBLE / rest_weight::DOUBLE * weight END AS target FROM r),
c AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS copies FROM t),
k AS (
  SELECT d.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS rest
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
u AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source, h) AS same
  FROM k),
b AS (
  SELECT source, min(CASE WHEN upto >= rest THEN h END) AS edge FROM u GROUP BY source),
x AS (
  SELECT u.source, b.edge + max(CASE WHEN u.h = b.edge AND abs(u.same - (u.rest - (u.upto - u.same))) < abs(u.rest - (u.upto - u.same))
                                THEN 1 ELSE 0 END) AS threshold
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source GROUP BY u.source, b.edge)
SELECT u.doc_id, u.size, u.source_size, u.target,
       (u.size * (u.copies + CASE WHEN u.h < x.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN x ON u.source IS NOT DISTINCT FROM x.source
"""


@query("op5_mix_sources", MIX_SQL)
def mix_sources(spark, sf_dir):
    """All of ``documents`` mixed to source weights 1, 2, 3, repeating."""
    return mix_to_weights(table(spark, sf_dir, "documents"))
