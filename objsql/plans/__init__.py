"""Dialects and the query engine."""

from objsql.plans.engine import Engine
from objsql.plans.dialect import DialectError, check

__all__ = ["DialectError", "Engine", "check"]
