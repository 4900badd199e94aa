"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from . import q_agreement, q_eval, q_io, q_models, q_odd, q_score, q_scoretable, q_stream, q_text, q_topics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
