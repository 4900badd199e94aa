"""Query of the embedding near-duplicates."""

from __future__ import annotations

from .neardup_vectors import near_duplicates
from .registry import query, table

LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
c(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT c.vec_id, l.b FROM c JOIN l ON c.reach = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(c.reach) AS component_id,
       e.vec_id = min(c.reach) AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id GROUP BY e.vec_id
"""


@query("op8_embedding_neardup", LINKS_SQL)
def embedding_neardup(spark, sf_dir):
    """All rows of ``embeddings``, linked at cosine 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
