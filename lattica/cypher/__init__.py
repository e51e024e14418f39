"""A read-only subset of Cypher, compiled to DataFrame operations."""

from lattica.cypher.compiler import run
from lattica.cypher.lexer import QueryError, check_read_only

__all__ = ["QueryError", "check_read_only", "run"]
