"""Registered queries. Importing the package fills the two registries."""

from jobtrail.plans import (  # noqa: F401
    capacity_queries, function_queries, ledger_queries, request_queries, source_queries,
    streaming_queries,
)
from jobtrail.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
