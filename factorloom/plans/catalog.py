"""All registered queries."""

from factorloom.plans import queries_labels, queries_metrics, queries_panel, queries_tables
from factorloom.plans.registry import oracle_queries, spark_queries, tidy

__all__ = [
    "oracle_queries",
    "queries_labels",
    "queries_metrics",
    "queries_panel",
    "queries_tables",
    "spark_queries",
    "tidy",
]
