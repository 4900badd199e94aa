"""Query of the conversation prefix trie."""

from __future__ import annotations

from .prefix_trie import prefix_trie
from .registry import query, table


@query("op11_prefix_trie")
def conversation_trie(spark, sf_dir):
    """Every prefix of all rebuilt ``conversations``; tested against a brute-force trie."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
