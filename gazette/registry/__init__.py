"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from . import articles, checks, feeds, search, signals, stored  # noqa: F401 - modules register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
