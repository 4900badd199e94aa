"""Imports every module that registers queries."""

from . import q_bilinear, q_chat, q_jaccard, q_langid, q_mixing, q_neardup, q_negatives, q_packing, q_quality, q_search, q_tokens, q_trie, q_warc  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
