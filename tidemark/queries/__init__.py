"""Registered queries and the SQL that each must agree with."""

from __future__ import annotations

from tidemark.queries import analytics, incremental, relational, services  # noqa: F401
from tidemark.queries.registry import ORACLES, QUERIES  # noqa: F401
