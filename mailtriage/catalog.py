"""All registered queries (import side effect fills the registry)."""
from __future__ import annotations

from .plans import q_commit, q_features, q_model, q_observe, q_review, q_rules, q_scalars, q_stream, q_tables, q_triage  # noqa: F401
from .plans.registry import BENCH, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "BENCH"]
