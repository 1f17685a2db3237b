"""All registered queries."""

from rubricon.plans import data_queries, report_queries, retrieval_queries, text_queries  # noqa: F401
from rubricon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
