"""Query of the token counts."""

from __future__ import annotations

import public_tokenizers

from .registry import query, table
from .tokencount import token_counts


@query("op6_token_counts")
def count_tokens(spark, sf_dir):
    """Tokens of every whole text of ``documents``; tested against the tokenizer's own library."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
