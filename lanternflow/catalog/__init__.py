"""Every operator as a query over the given tables."""

from lanternflow.catalog.registry import QUERIES, SQL
from lanternflow.catalog import evaluation, events, live, scores, tabular, windows

__all__ = ["QUERIES", "SQL", "evaluation", "events", "live", "scores", "tabular", "windows"]
