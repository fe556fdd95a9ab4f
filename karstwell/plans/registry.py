"""Named queries over the driver's tables, and the SQL each of them equals."""

from __future__ import annotations

from karstwell.plans import coverage, joins, research, scalars, search, stats  # noqa: F401
from karstwell.plans._register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
