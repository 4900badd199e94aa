"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from .neardup_sets import similar_documents
from .registry import query, table

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END) AS shingles FROM w),
g AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT c.doc_id, p.b FROM c JOIN p ON c.reach = p.a)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, min(c.reach) AS component_id
FROM s JOIN c ON c.doc_id = s.doc_id GROUP BY s.doc_id, s.shingles
"""


@query("op9_jaccard_join", JACCARD_SQL)
def jaccard_join(spark, sf_dir):
    """Every whole text of ``documents`` with its near-duplicate class."""
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
