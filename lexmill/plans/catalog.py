"""All queries of the record engine, gathered from their modules."""

from . import brief, calendar, cases, commands, correspondence, custody, drafts, guards, layout, ledgers, machines, packages, rulebooks, scoring, screening, texts, transactions, workspace  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
