"""All core queries and their SQL."""

from __future__ import annotations

from mnemospark.plans import assembled_queries, composite_queries, extraction_queries, more_queries, record_queries, retrieval_queries, text_queries  # noqa: F401  (they register their queries)
from mnemospark.plans.registry import QUERIES, SQL  # noqa: F401
