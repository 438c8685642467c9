"""All registered queries: importing the modules registers theirs."""

from panelspark.plans import file_queries, more_queries
from panelspark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "file_queries", "more_queries"]
