"""Corpus analytics on PySpark: search, roll-ups, audits, triage, judgments and export over a table of files."""

from shelfmark.policy import Policy, Root

__all__ = ["Policy", "Root"]
