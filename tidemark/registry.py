"""Every query by name, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from .plans import audits, boards, cases, companies, history, linking, market, periods, planner, reads, reference, research, roles, stream, textual, values  # noqa: F401  (they register their queries)
from .plans.queries import ORACLES, QUERIES

FLAGSHIP = "theme_return_rank"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
