"""Registered queries: each operator over whole tables, with SQL of its own where SQL can say it."""

from __future__ import annotations

from reviewmill.plans.queries import cleaning, periods, redaction, replies, reports, scalars, themes
from reviewmill.plans.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "periods", "redaction", "replies", "reports", "scalars", "themes"]
