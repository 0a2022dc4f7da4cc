"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from locale_lake.plans import model_queries, reuse_queries, run_queries, text_queries, tree_queries  # noqa: F401
from locale_lake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
