"""All queries over the given tables, by name, and the same in SQL."""

from . import alignment_queries, episode_queries, table_queries  # noqa: F401  they register themselves
from .binding import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
