"""All registered queries."""

from shelfmark.plans import claim_queries, corpus_queries, export_queries  # noqa: F401
from shelfmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
