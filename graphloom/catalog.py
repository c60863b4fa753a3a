"""All queries of the engine's own operators, by name, with their SQL equivalents."""

from graphloom.plans import code_queries, codebase_queries, context_queries, repository_queries, structure_queries  # noqa: F401  register their queries
from graphloom.plans.queries import CHECKS, EXPECTED, ORACLES, QUERIES

__all__ = ["CHECKS", "EXPECTED", "ORACLES", "QUERIES"]
