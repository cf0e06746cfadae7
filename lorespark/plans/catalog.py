"""All registered queries and their SQL."""

from __future__ import annotations

from lorespark.plans import (  # noqa: F401
    search_queries,
    table_queries,
    text_queries,
    vector_queries,
    wiki_queries,
)
from lorespark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
