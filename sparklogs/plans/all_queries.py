"""Every registered query of the library."""

from __future__ import annotations

from sparklogs.plans import eval_queries, log_queries
from sparklogs.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "eval_queries", "log_queries"]
