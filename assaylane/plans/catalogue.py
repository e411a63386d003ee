"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from . import curation, models, relations, reports, sequence, statistics, structures  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
