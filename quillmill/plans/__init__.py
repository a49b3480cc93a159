"""Every query by name, with its SQL."""

from . import compiled, composites, documents, layers, rules, served, structure  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
