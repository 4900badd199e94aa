"""Query of the best-fit packing."""

from __future__ import annotations

import public_tokenizers

from .packing import pack_documents
from .registry import query, table


def tokenizer_files() -> dict:
    """The byte-level vocabulary, as the library's file and as ranks (the same ids)."""
    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


@query("op10_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    """All ``documents`` in sequences of at most 1024 tokens; tested against the library and by an exact round trip."""
    return pack_documents(table(spark, sf_dir, "documents"), **tokenizer_files(), capacity=1024)
