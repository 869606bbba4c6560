"""Operators of a training-data pipeline, and their queries over the given tables."""

from lanternflow.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
