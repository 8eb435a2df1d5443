"""All registered queries."""

from __future__ import annotations

from . import browsing, layouts, live, lookups, memory, notes_live, pages, reports, search, store_ops, streams, surface, writes  # noqa: F401  registering is importing
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
