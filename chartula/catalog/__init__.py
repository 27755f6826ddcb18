"""Named queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from chartula.catalog import registry
from chartula.catalog import corpus_queries, graph_queries, ingest_queries, search_queries, source_queries, text_queries, usage_queries  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
