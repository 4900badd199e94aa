"""Query of the language-model scores."""

from __future__ import annotations

from .log_bilinear import held_out, language_model_scores
from .registry import query, table


@query("op13_lm_scores")
def lm_scores(spark, sf_dir):
    """Base and model score of every whole text of ``documents``; tested against brute force."""
    return language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id"))
