"""Continuous analytics on Spark: a small forgiving SQL dialect over event tables and streams."""

from .operators.engine import Engine, Result
from .plans.errors import QueryError
from .sources.catalog import Table

__all__ = ["Engine", "QueryError", "Result", "Table"]
