"""All queries of the library proper."""

from glosswright.plans import exchange_queries, layout_queries, model_queries, table_queries, text_queries  # noqa: F401
from glosswright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
