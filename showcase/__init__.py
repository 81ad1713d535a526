"""Queries over the test tables, one or more per operator, with their SQL counterparts."""

from showcase import checking, conforming, differences, loading, numbering, reconciling, transfer, values
from showcase.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checking", "conforming", "differences", "loading", "numbering", "reconciling", "transfer", "values"]
