"""Every registered query and, where SQL can express it, the equivalent SQL."""

from __future__ import annotations

from . import record_queries, text_queries

QUERIES = {**text_queries.QUERIES, **record_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **record_queries.ORACLES}
