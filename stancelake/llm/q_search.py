"""Query of the exact top-k search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .topk import exhaustive_topk, quantized

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
e AS (SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""


@query("op2_exact_topk", TOPK_SQL)
def exact_topk(spark, sf_dir):
    """Queries: ids divisible by 20; candidates: every other row of ``embeddings``."""
    return exhaustive_topk(quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)
