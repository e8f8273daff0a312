"""All registered queries of the library and their oracle SQL."""

from tidewatch.plans import queries_runs  # noqa: F401  registers on import
from tidewatch.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
