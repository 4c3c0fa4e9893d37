"""The package's operators on the given tables, with equivalent SQL."""

from catalog import boards, companies, ranking, runs  # noqa: F401  (fill the registry)
from catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
