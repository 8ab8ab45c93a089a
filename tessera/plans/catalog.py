"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from tessera.plans import chart_queries, corpus_queries, eval_queries, search_queries, text_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
