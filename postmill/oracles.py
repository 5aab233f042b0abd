"""The queries in DuckDB's SQL."""

from postmill.queries import ORACLES

__all__ = ["ORACLES"]
