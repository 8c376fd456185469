"""Registered queries: each binds operators to the tables of a folder."""

from __future__ import annotations

from glosswork.plans import corpus, evaluation, evaluators, flows, reconcile, relational, retrieval, statistics
from glosswork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "evaluation", "evaluators", "flows", "reconcile", "relational", "retrieval", "statistics"]
