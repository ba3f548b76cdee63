"""One query per operation over its whole table, and the SQL that says the same."""

from __future__ import annotations

from . import diff_queries, layout_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "diff_queries", "layout_queries", "text_queries"]
