"""All queries of the engine and their oracle SQL."""

from bibspark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
