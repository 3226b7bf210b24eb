"""Queries over the given tables with their plain-SQL checks."""

from checks import reads, rules, streams, texts  # noqa: F401  (they register their queries)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
