"""All queries over the test tables, and their SQL."""

from __future__ import annotations

from . import crawl_queries, flow_queries, page_queries, programme_queries, search_queries, state_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
