"""Query of the hard-negative mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import finite_vector
from .hard_negatives import hard_negatives
from .registry import query, table

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
e AS (SELECT vec_id, label, unnest(w) AS w, generate_subscripts(w, 1) AS d FROM v),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(sum(a.w * c.w) AS BIGINT) AS score
  FROM e a JOIN e c ON a.d = c.d AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0
  GROUP BY 1, 2, 3),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same)
  WHERE r <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
WHERE rank <= 10
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark, sf_dir):
    """Anchors: ids divisible by 100; positives and negatives: all other rows of ``embeddings`` with a label and a finite vector."""
    vectors = table(spark, sf_dir, "embeddings").filter(finite_vector(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    weights = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    rows = vectors.select("vec_id", moved.alias("label"), weights.alias("weights"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
