"""All queries of the measurement operators, and their SQL."""

from __future__ import annotations

from . import learn, relational, resample, scores, stores, streams, structures  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
