"""Every registered query of the table-quality operators, with its SQL where SQL can express it."""

from __future__ import annotations

from . import queries_clean, queries_quality, queries_rules  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
