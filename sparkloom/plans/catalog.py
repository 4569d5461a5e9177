"""All registered queries and their SQL."""

from __future__ import annotations

from sparkloom.plans import analytics, changes, clusters, conversations, cycles, evolution, functions, pipelines, reads, search, trees, workspaces  # noqa: F401
from sparkloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
