"""Query of the quality classifier."""

from __future__ import annotations

from .kneser_ney import classify
from .registry import query, table

TRUSTED = "quality = 1 and coalesce(toxic, 0) = 0"


@query("op4_quality")
def quality(spark, sf_dir):
    """Perplexity and decision for every whole text of ``documents``, trusted by ``labels``; tested against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify(docs, table(spark, sf_dir, "labels"), TRUSTED)
    return out.select("doc_id", "lang", "perplexity", "threshold", "accepted")
