"""All registered queries of the core library, by family."""

from __future__ import annotations

from quern.plans import corpus, events, metrics, storage, textual, windowed  # noqa: F401  registration
from quern.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
