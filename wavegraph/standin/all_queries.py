"""All registered queries; importing a module adds its queries."""

from wavegraph.standin import catalog_queries, graph_queries, log_queries, source_queries  # noqa: F401
from wavegraph.standin.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
