"""Operators for preparing language-model training data, and their registered queries."""

from jobtrail.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
