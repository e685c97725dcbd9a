"""Composed plans: the derived tables, the registered queries and their
independent DuckDB statements."""

from hashtrend.plans.tables import INDICATOR_COLUMNS, IndicatorTables, vector_text

__all__ = ["INDICATOR_COLUMNS", "IndicatorTables", "vector_text"]
